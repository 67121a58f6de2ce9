"""Secrets in text, and who else has them: candidates are counted over the corpus by distinct owners and repositories.

Three kinds of base spans are found by fixed patterns. Long runs of mixed characters are further candidates. Hashes of
all candidates are counted by repository and owner: a value that many owners hold, or that is copied into a great many
repositories, is a widely copied example; one that a single owner holds and that looks random is taken to be live. Live runs
become spans of the kind ``owned``; base spans always stay.

All expressions are native. Counts are aggregated before they are shuffled, so a value in a third of all documents is
a few partial rows; candidates meet their counts in a join whose skewed partitions Spark can split.

Results in special cases: a NULL text counts as empty and has no spans; repeated rows are searched each and are one
repository if they share its column; a NULL owner or repository counts as one more owner or repository; an empty table
gives no rows; very long texts are searched whole; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import stage
from granary.llm.common import written

# The three base kinds, with the least length of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: A cheap sign that a text may hold such a match at all.
SIGNS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "owned": r"[A-Za-z0-9+/_-]{20}"}
#: Further candidates: runs of these characters that hold a digit and a letter.
RUN = r"[A-Za-z0-9+/_-]+"
RUN_LEAST = 20
KINDS = ("assign", "access", "hex", "owned")
#: From so many owners on, a value is an example that is handed around.
WIDE_OWNERS = 3
#: From so many repositories on, it is one too, whoever owns them: a template or sample text of a single owner.
WIDE_REPOSITORIES = 50
LEAST_DISTINCT = 10
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def find_spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters; code points, end exclusive."""
    found, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern)
    parts = F.zip_with(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("size"))), value, lambda p, v: F.struct(p["skip"].alias("skip"), p["size"].alias("size"), v.alias("value")))
    none = F.array().cast(SPAN)
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["skip"] + p["size"]).alias("at"),
            F.when(
                F.length(p["value"]) >= least,
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + p["skip"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + p["skip"] + p["size"]).alias("end"), p["value"].alias("value"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return F.when(F.rlike(text, F.lit(SIGNS[KINDS[kind]])), walked).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def looks_random(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (distinct >= LEAST_DISTINCT) & F.rlike(value, F.lit("[0-9]"))


def with_candidates(docs: DataFrame, text: str, owner: str, repository: str, keep: list[str]) -> DataFrame:
    """keep, owner, repository, base spans and runs of each row; the rows are numbered by ``_row``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(*keep, F.col(owner).alias("_owner"), F.col(repository).alias("_repository"), body.alias("_text")),
                 {f"_{kind}": find_spans(F.col("_text"), k, *spec) for k, (kind, *spec) in enumerate(BASE)} | {"_runs": find_spans(F.col("_text"), 3, RUN, 0, RUN_LEAST)})
    rows = stage(rows, {"_base": F.sort_array(F.concat("_assign", "_access", "_hex"))})
    free = lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    mixed = lambda r: F.rlike(r["value"], F.lit("[0-9]")) & F.rlike(r["value"], F.lit("[A-Za-z]"))
    runs = F.filter("_runs", lambda r: mixed(r) & free(r))
    counts = {f"n_{kind}": F.size(f"_{kind}").cast("long") for kind, *_ in BASE}
    return rows.select(*keep, "_owner", "_repository", *[c.alias(n) for n, c in counts.items()], "_base", runs.alias("_runs"), F.monotonically_increasing_id().alias("_row"))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners over the corpus."""
    once = candidates.groupBy("hash", "_owner", "_repository").agg(F.count("*").alias("n"))
    owners = once.groupBy("hash", "_owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", keep: list[str] | None = None,
                 wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """``keep``, n_assign, n_access, n_hex, base (spans), found (all spans with value, owners, repositories, verdict)."""
    keep = ["doc_id"] if keep is None else keep
    rows = written(with_candidates(docs, text, owner, repository, keep), "secrets")
    each = rows.select("_row", "_owner", "_repository", F.explode(F.concat("_base", "_runs")).alias("span"))
    each = each.withColumn("hash", F.sha2(F.col("span.value"), 256))
    counts = ownership(each)
    met = each.select("_row", "span", "hash").join(counts, "hash")
    verdict = F.when((F.col("n_owners") >= wide_owners) | (F.col("n_repositories") >= wide_repositories), "example").when((F.col("n_owners") == 1) & looks_random(F.col("span.value")), "live").otherwise("unclear")
    met = met.withColumn("verdict", verdict).where((F.col("span.kind") < 3) | (F.col("verdict") == "live"))
    found = met.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("span.start", "span.kind", "span.end", "span.value", "n_owners", "n_repositories", "verdict"))).alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    return rows.join(found, "_row", "left").select(*keep, *[f"n_{k}" for k, *_ in BASE], F.col("_base").alias("base"), F.coalesce("found", none).alias("found"))
