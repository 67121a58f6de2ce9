"""File-system questions asked through Hadoop, so any cluster storage answers them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct sub-folders."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


#: Files up to this size are hashed as one value; larger ones are read piece by piece.
WHOLE_FILE_BYTES = 256 << 20
PIECE_BYTES = 8 << 20


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE_FILE_BYTES) -> DataFrame:
    """SHA-256 and size of every data file below ``path``, one row per file of any size.

    Only the files that fit ``whole`` are loaded as values, which the scan itself decides.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    small = files.where(F.col("length") <= whole).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place in batch["path"]:
                fs, inner = FileSystem.from_uri(place)
                digest, size = hashlib.sha256(), 0
                with fs.open_input_stream(inner) as stream:
                    while piece := stream.read(PIECE_BYTES):
                        digest.update(piece)
                        size += len(piece)
                out.append((place.rsplit("/", 1)[-1], size, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["file", "bytes", "sha256"])

    large = files.where(F.col("length") > whole).select("path").mapInPandas(digests, "file string, bytes bigint, sha256 string")
    return small.unionByName(large)


def combined_digest(hashes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Order-free digest of a set of files: the four 64-bit quarters are xor-ed apart."""
    quarters = [
        F.bit_xor(F.conv(F.substring("sha256", 1 + 16 * i, 16), 16, -10).cast("bigint")).cast("string").alias(f"q{i}")
        for i in range(4)
    ]
    parts = hashes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("size_bytes"), *quarters
    )
    digest = F.sha2(F.concat_ws(":", F.col("files").cast("string"), *[f"q{i}" for i in range(4)]), 256)
    return parts.select(*by, "files", "size_bytes", digest.alias("sha256"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Row count plus xor and sum of row hashes: equal for equal row sets in any file layout."""
    row = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("hash_sum"),
    )


def state(spark: SparkSession, path: str) -> tuple:
    """Name, time, size and number of files of whatever lies directly in ``path``: it changes when a table there is rewritten."""
    fs, p = _fs(spark, path)
    found = [(s.getPath(), s.getModificationTime()) for s in fs.listStatus(p)]
    sized = [(q.getName(), at, fs.getContentSummary(q)) for q, at in found]
    return tuple(sorted((name, at, s.getLength(), s.getFileCount()) for name, at, s in sized))
