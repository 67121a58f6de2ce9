"""From raw documents to packed sequences, one operator a stage.

Every stage but the last returns the columns of ``documents``; each reads what the stage before it has written, and of
that the columns of ``documents`` alone, so further columns, whatever their names, are no part of any stage. An empty
table stays empty; NULLs, long texts, ties and repeated rows are treated as the stages' operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import best_two_fit, decision_list, line_dedup, simhash_trees, soft_mixing
from granary.llm.common import DOCUMENT_COLUMNS, table, written
from granary.llm.queries import WEIGHTS, packing_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    rules = decision_list.learn_from(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs.select(*DOCUMENT_COLUMNS), rules).where("kept").select(*DOCUMENT_COLUMNS)


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; those of which no word is left go."""
    rows = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS)).where(F.col("n_kept") > 0)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of equal ids, the one with the smallest hash of its text."""
    keyed = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("text").alias("_hash"))
    found = simhash_trees.near_copies(keyed, ["doc_id", "_hash"])
    first = found.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "_hash")).alias("first"))
    a, b = keyed.alias("a"), first.select("first.doc_id", "first._hash").alias("b")
    rows = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._hash") == F.col("b._hash")), "left_semi")
    place = F.expr("row_number() OVER (PARTITION BY doc_id, _hash ORDER BY lang, source, n_chars)")
    return rows.withColumn("_place", place).where("_place = 1").select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates ask for, with the fit of ``op5_soft_mixing``."""
    return soft_mixing.resample(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"), WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_two_fit.pack(docs, packing_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL has no counterpart of learned rules, fingerprints and tokens; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"corpus-{k}")
    return docs
