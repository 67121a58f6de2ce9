"""Parquet tables in partitions that can be loaded again, and updated in part, by overwriting partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import written
from granary.sources.files import exists
from granary.sources.landing import ROWS_PER_FILE


class PartitionedTable:
    """A table in the folders ``by=value`` of ``path``; ``schema`` names all its columns, ``by`` among them.

    A load replaces the partitions that its rows belong to and leaves the others alone, so a load that is repeated, by
    its caller or after a failure, changes nothing. Rows whose partition value is NULL are a partition of their own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str):
        self.spark, self.path, self.by = spark, path, by
        self.schema = spark.createDataFrame([], schema).schema

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def load(self, df: DataFrame) -> None:
        """``df`` must not read this table: see ``update``. Large partitions are written by several tasks."""
        typed = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).hint("rebalance", self.by)
        out = typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        out.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(self.by).parquet(self.path)

    def update(self, condition: Column, values: dict[str, Column]) -> DataFrame:
        """Sets ``values`` where ``condition`` holds; only partitions with such rows are read again and rewritten.

        Returns (partition value, affected_rows) of the rewritten ones. The new rows are staged before any file is
        replaced, so a failure while they are computed leaves the table as it was.
        """
        if self.by in values:
            raise ValueError(f"{self.by} places rows in partitions and cannot be updated; load the rows instead")
        hit = F.coalesce(condition, F.lit(False))
        touched = written(self.read().where(hit).groupBy(self.by).agg(F.count(F.lit(1)).alias("affected_rows")), "touched")
        # One value a partition, a list like the folder's own; as literals they prune the scan.
        found = [r[0] for r in touched.select(self.by).collect()]
        if found:
            place = F.col(self.by).isin([v for v in found if v is not None])
            if None in found:
                place = F.coalesce(place, F.lit(False)) | F.col(self.by).isNull()
            rows = self.read().where(place).withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
            self.load(written(rows, "update"))
        return touched
