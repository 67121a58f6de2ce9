"""URL verdicts from rules that are looked up by their rarest literal token.

A rule is a regular expression plus literal tokens that every URL it matches must hold. Each rule is filed under the
one of its tokens that is rarest in the corpus; the tokens of a URL fetch the rules filed under them, and only those
run their expression. Host rules such as ``example.com/en/`` are filed in the same way.

Results in special cases: a NULL URL, or one without ``://``, has an empty host and path and can be met by pattern
rules only; repeated rows get the same verdict each; no rules at all means that everything is allowed; further columns
of the input are ignored unless asked for with ``keep``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import stage
from granary.llm.common import ascii_lower

#: Up to this many rules the index is a constant of the query; a larger one is a table that is joined.
INDEX_LIMIT = 2000
TOKEN_BREAK = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``host`` rules see host and path and the longest wins; the others see the whole URL, and allowing ones win."""

    text: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    host: bool = False


def host_rule(text: str, verdict: str) -> Rule:
    """``text``: a host, then the start of a path. Fits the host and its subdomains."""
    host, slash, path = text.partition("/")
    host = host.translate({c: c + 32 for c in range(65, 91)})
    found = re.findall("[a-z0-9]+", (host + slash + path).lower())
    if found and re.search("[A-Za-z0-9]$", text) and slash:
        found = found[:-1]  # the last token may go on in the URL
    return Rule(text, verdict, r"^([^/]*\.)?" + _quoted(host + slash + path), tuple(found), True)


def pattern_rule(text: str, verdict: str, pattern: str, *literals: str) -> Rule:
    if not literals:
        raise ValueError(f"rule {text} names no literal token")
    return Rule(text, verdict, pattern, tuple(literals))


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", lambda m: "[" + m[1] + "]" if m[1] not in "^\\[]" else "\\" + m[1], s)


def url_parts(url: Column) -> dict[str, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(ascii_lower(host), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(F.coalesce(url, F.lit(""))), TOKEN_BREAK), lambda t: t != ""))


def token_counts(pages: DataFrame, url: str, wanted: set[str]) -> dict[str, int]:
    """In how many rows each wanted token occurs; no larger than the rules."""
    if not wanted:
        return {}
    tokens = pages.select(F.explode(url_tokens(F.col(url))).alias("token")).where(F.col("token").isin(sorted(wanted)))
    return {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rarest_token(rule: Rule, counts: dict[str, int]) -> str:
    return min(rule.literals, key=lambda t: (counts.get(t, 0), -len(t), t))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), index_limit: int = INDEX_LIMIT) -> DataFrame:
    """``keep``, host, path, rule (the host rule that decides), pattern (the other rule that fits, if any), verdict."""
    for r in rules:
        if not r.literals:
            raise ValueError(f"rule {r.text} has no literal token to be found by")
    counts = token_counts(pages, url, {t for r in rules for t in r.literals})
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(rarest_token(r, counts), []).append(r)
    source = pages.select(*keep, F.col(url).alias("_url"))
    rows = stage(source, url_parts(F.col("_url")))
    if not filed:
        return _verdicts(rows.withColumns({"_host": F.lit(None), "_other": F.lit(None)}), keep)
    if len(rules) > index_limit:
        return _verdicts(_joined(rows, filed), keep)
    entry = lambda r: F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.host).alias("host"))
    index = F.create_map(*[x for token, found in sorted(filed.items()) for x in (F.lit(token), F.array(*map(entry, found)))])
    rows = stage(rows, {"_found": F.flatten(F.transform(F.filter(url_tokens(F.col("_url")), lambda t: t.isin(sorted(filed))), lambda t: index[t]))})
    fits = F.filter("_found", lambda r: F.rlike(F.when(r["host"], F.concat("host", "path")).otherwise(F.col("_url")), r["pattern"]))
    rows = stage(rows, {"_fits": fits})
    best = lambda of, rank: F.array_max(F.transform(F.filter("_fits", of), lambda r: F.struct(rank(r).alias("rank"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    return _verdicts(rows.withColumns({"_host": best(lambda r: r["host"], _host_rank), "_other": best(lambda r: ~r["host"], _other_rank)}), keep)


def _host_rank(r: Column) -> Column:
    return F.length(r["text"])


def _other_rank(r: Column) -> Column:
    return F.when(r["verdict"] == "allow", 1).otherwise(0)


def _joined(rows: DataFrame, filed: dict[str, list[Rule]]) -> DataFrame:
    """The same for long lists of rules: distinct URLs meet the rules in a join on the token."""
    spark = rows.sparkSession
    listed = [(t, r.text, r.verdict, r.pattern, r.host) for t, found in sorted(filed.items()) for r in found]
    rules = spark.createDataFrame(listed, "token string, text string, verdict string, pattern string, is_host boolean")
    urls = rows.select("_url", "host", "path").distinct()
    met = urls.select("*", F.explode(url_tokens(F.col("_url"))).alias("token")).join(rules, "token")
    met = met.where(F.rlike(F.when(F.col("is_host"), F.concat("host", "path")).otherwise(F.col("_url")), F.col("pattern")))
    r = {"text": F.col("text"), "verdict": F.col("verdict")}
    ranked = lambda rank: F.struct(rank(r).alias("rank"), F.col("text"), F.col("verdict"))
    best = met.groupBy("_url").agg(F.max(F.when(F.col("is_host"), ranked(_host_rank))).alias("_host"), F.max(F.when(~F.col("is_host"), ranked(_other_rank))).alias("_other"))
    return rows.join(best, "_url", "left")


def _verdicts(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    struct = "struct<rank:int,text:string,verdict:string>"
    host, other = F.col("_host").cast(struct), F.col("_other").cast(struct)
    return rows.select(
        *keep, "host", "path", host["text"].alias("rule"), other["text"].alias("pattern"), F.coalesce(host["verdict"], other["verdict"], F.lit("allow")).alias("verdict")
    )
