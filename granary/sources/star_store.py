"""The star schema as plain Parquet: dimensions are replaced whole, facts year by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.star import SCHEMAS, empty_table
from granary.session import written
from granary.sources.files import exists
from granary.sources.landing import write_snappy
from granary.sources.partitioned import PartitionedTable

YEAR = "anio"
FACTS = ("fact_produccion_eva", "fact_precios_sipsa", "fact_clima_ideam")


class StarStore:
    """A fact table is loaded by the years that the load has rows of: loading it again changes nothing, other years stay."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def facts(self, name: str) -> PartitionedTable:
        return PartitionedTable(self.spark, self._path(name), f"{SCHEMAS[name]}, {YEAR} int", YEAR)

    def initialize(self) -> None:
        """Creates what is missing; existing tables keep their rows."""
        for name in SCHEMAS:
            if not exists(self.spark, self._path(name)):
                self.load(name, empty_table(self.spark, name))

    def load(self, name: str, df: DataFrame) -> None:
        """``df`` may read the table itself if it is no fact table: its rows are staged first if so."""
        typed = df.select(*[df[f.name].cast(f.dataType) for f in empty_table(self.spark, name).schema.fields])
        if name in FACTS:
            self.facts(name).load(typed.withColumn(YEAR, F.floor(F.col("id_tiempo") / 100)))
        else:
            write_snappy(written(typed, name) if exists(self.spark, self._path(name)) else typed, self._path(name))

    def table(self, name: str) -> DataFrame:
        if name in FACTS:
            return self.facts(name).read().drop(YEAR)
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name))
