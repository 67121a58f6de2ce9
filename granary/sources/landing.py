"""Raw landing zone and the cleaned and indicator stores."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.nulls import attach
from granary.operators.cleaning import CLEANER_ALIASES, clean
from granary.sources.files import combined_digest, exists, file_hashes

ROWS_PER_FILE = 5_000_000
MANIFEST_SCHEMA = (
    "dataset string, path string, rows bigint, columns array<string>, files bigint, size_bytes bigint, "
    "sha256 string, saved_at timestamp"
)
FILES_SCHEMA = "dataset string, file string, bytes bigint, sha256 string, saved_at timestamp"


def with_suffix(name: str) -> str:
    return name if name.endswith(".parquet") else f"{name}.parquet"


def write_snappy(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        df.write.mode(mode)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .parquet(path)
    )


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """Row count of what is on disk (answered from the file footers)."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


class Landing:
    """Write-once datasets with an append-only manifest; the newest entry per dataset counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, category: str, name: str) -> str:
        return f"{self.root}/{category.lower()}/{with_suffix(name)}"

    def _read(self, kind: str, schema: str) -> DataFrame:
        """An absent or unreadable manifest is an empty one."""
        try:
            return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{self.root}/_{kind}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """Current entry per dataset."""
        log = self._read("manifest", MANIFEST_SCHEMA)
        rest = [c for c in log.columns if c not in ("dataset", "saved_at")]
        return log.groupBy("dataset").agg(*[F.max_by(c, "saved_at").alias(c) for c in rest], F.max("saved_at").alias("saved_at"))

    def manifest_files(self) -> DataFrame:
        log = self._read("files", FILES_SCHEMA)
        newest = log.groupBy("dataset").agg(F.max("saved_at").alias("saved_at"))
        return log.join(newest, ["dataset", "saved_at"], "left_semi")

    def save_raw(self, df: DataFrame, category: str, name: str, overwrite: bool = False) -> DataFrame:
        """One manifest row. Existing data is left alone unless ``overwrite`` is set, and is
        then reported as it is stored."""
        path, dataset = self.path(category, name), f"{category}/{with_suffix(name)}"
        if exists(self.spark, path) and not overwrite:
            known = self.manifest().filter(F.col("dataset") == dataset)
            return known.withColumn("status", F.lit("EXISTING_UNCHANGED")) if not known.isEmpty() else self._entry(
                path, dataset, "EXISTING_UNCHANGED"
            )
        write_snappy(df, path)
        entry = self._entry(path, dataset, "SAVED")
        entry.drop("status").write.mode("append").parquet(f"{self.root}/_manifest")
        saved = self.manifest().filter(F.col("dataset") == dataset)
        hashes = file_hashes(self.spark, path).withColumn("dataset", F.lit(dataset))
        stamped = attach(hashes, saved.select("dataset", "saved_at"), ["dataset"], "inner")
        stamped.select("dataset", "file", "bytes", "sha256", "saved_at").write.mode("append").parquet(f"{self.root}/_files")
        return saved.withColumn("status", F.lit("SAVED"))

    def _entry(self, path: str, dataset: str, status: str) -> DataFrame:
        stored = self.spark.read.parquet(path)
        digest = combined_digest(file_hashes(self.spark, path))
        rows = stored.agg(F.count(F.lit(1)).alias("rows"))
        return rows.join(digest, on=F.lit(True), how="left").select(
            F.lit(dataset).alias("dataset"),
            F.lit(path).alias("path"),
            "rows",
            F.array(*[F.lit(c) for c in stored.columns]).alias("columns"),
            "files",
            "size_bytes",
            "sha256",
            F.current_timestamp().alias("saved_at"),
            F.lit(status).alias("status"),
        )

    def verify_integrity(self) -> DataFrame:
        """(dataset, intact): every recorded file is there with its recorded hash, and no other."""
        recorded = self.manifest_files()
        current = None
        # One path per dataset (a registry-sized list, not data).
        for r in self.manifest().select("dataset", "path").toLocalIterator():
            if exists(self.spark, r["path"]):
                found = file_hashes(self.spark, r["path"]).select(F.lit(r["dataset"]).alias("dataset"), "file", F.col("sha256").alias("now"))
                current = found if current is None else current.unionByName(found)
        if current is None:
            return recorded.select("dataset", F.lit(False).alias("intact")).distinct()
        both = recorded.alias("m").join(current.alias("c"), ["dataset", "file"], "full_outer")
        same = F.coalesce(F.col("m.sha256") == F.col("c.now"), F.lit(False))
        return both.groupBy("dataset").agg(F.bool_and(same).alias("intact"))


class CleanStore:
    """Cleaned layer: cleaner by name, then one summary row."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def process_and_save(self, df: DataFrame, name: str, cleaner: str) -> DataFrame:
        path = f"{self.root}/{with_suffix(name)}"
        write_snappy(clean(df, cleaner), path)
        before = df.agg(F.count(F.lit(1)).alias("initial_rows"))
        after = stored_rows(self.spark, path).select(F.col("rows").alias("final_rows"))
        digest = combined_digest(file_hashes(self.spark, path))
        return (
            before.join(after, on=F.lit(True), how="left")
            .join(digest, on=F.lit(True), how="left")
            .select(
                F.lit(name).alias("dataset_name"),
                "initial_rows",
                "final_rows",
                (F.col("initial_rows") - F.col("final_rows")).alias("removed_duplicates"),
                F.lit(path).alias("target_path"),
                "sha256",
                F.col("size_bytes").alias("file_size_bytes"),
            )
        )


class IndicatorStore:
    """Indicator layer: save, describe, load."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{with_suffix(name)}"
        write_snappy(df, path)
        digest = combined_digest(file_hashes(self.spark, path))
        return stored_rows(self.spark, path).join(digest, on=F.lit(True), how="left").select(
            F.lit(name).alias("dataset_name"),
            F.lit(path).alias("target_path"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.col("size_bytes").alias("file_size_bytes"),
            "sha256",
        )

    def load(self, name: str) -> DataFrame:
        """A missing dataset surfaces as Spark's own path-not-found error."""
        return self.spark.read.parquet(f"{self.root}/{with_suffix(name)}")


# Name fragments that choose a cleaner for a raw dataset.
STATION_WORDS = ("precipitacion", "temperatura", "radiacion")


def cleaner_for(category: str, name: str) -> str:
    """Cleaner of a raw dataset by its folder and name."""
    if "eva" in name:
        return "eva"
    if any(alias in name for alias in CLEANER_ALIASES):
        return "trade"
    if "ideam" in category or any(w in name for w in STATION_WORDS):
        return "ideam"
    if "sipsa" in name or category == "dane":
        return "sipsa"
    return "generic"


def sweep(landing: Landing, store: CleanStore) -> DataFrame:
    """Every landed dataset through its cleaner; one job per dataset of the registry."""
    summaries = []
    for r in landing.manifest().select("dataset", "path").orderBy("dataset").toLocalIterator():
        category, file = r["dataset"].split("/", 1)
        stem = file.removesuffix(".parquet")
        raw = landing.spark.read.parquet(r["path"])
        kind = cleaner_for(category.lower(), stem)
        summaries.append(store.process_and_save(raw, f"{stem}_silver", kind).withColumn("cleaner", F.lit(kind)))
    return reduce(DataFrame.unionByName, summaries)
