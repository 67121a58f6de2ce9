"""One query per operator of this package over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    best_two_fit,
    decision_list,
    html_density,
    importance_resampling,
    language_id,
    line_dedup,
    multiset_hash,
    ngram_product,
    ns_clustering,
    secret_frequency,
    simhash_trees,
    soft_mixing,
    url_rules,
)
from granary.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- URL filters -----------------------------------------------------------------------------------------------------

HOST_RULES = [
    url_rules.host_rule("com/", "allow"),
    url_rules.host_rule("example.com/en/", "block"),
    url_rules.host_rule("www.example.com/en/", "allow"),
    url_rules.host_rule("net/es/", "block"),
    url_rules.host_rule("net/fr/", "block"),
]
PATTERN_RULES = [  # every literal is a whole token of each URL that the pattern matches
    url_rules.pattern_rule("pills", "block", r"://([^/?#]*[.-])?cheap-pills[.-]", "cheap", "pills"),
    url_rules.pattern_rule("casino host", "block", r"://([^/?#]*[.-])?casino[.-]", "casino"),
    url_rules.pattern_rule("advert server", "block", r"://ads\.", "ads"),
    url_rules.pattern_rule("tracker", "block", r"/track/", "track"),
    url_rules.pattern_rule("session", "block", r"[?&]phpsessid=", "phpsessid"),
    url_rules.pattern_rule("program", "block", r"\.exe([?#]|$)", "exe"),
    url_rules.pattern_rule("feed copy", "block", r"[?&]utm_source=feed(&|#|$)", "utm", "source", "feed"),
    url_rules.pattern_rule("first page", "allow", r"[?&]page=1(&|#|$)", "page", "1"),
]


def _url_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    subject = {True: "host || path", False: "coalesce(url, '')"}
    listed = lambda host: ", ".join(
        f"CASE WHEN regexp_matches({subject[host]}, {quoted(r.pattern)}) THEN {{'rank': {len(r.text) if host else int(r.verdict == 'allow')}, 'text': {quoted(r.text)}, 'verdict': {quoted(r.verdict)}}} END"
        for r in (HOST_RULES if host else PATTERN_RULES)
    )
    best = lambda host: f"list_max(list_filter([{listed(host)}], lambda x: x IS NOT NULL))"
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
best AS (SELECT *, {best(True)} AS h, {best(False)} AS o FROM parts)
SELECT page_id, host, path, h.text AS rule, o.text AS pattern, coalesce(h.verdict, o.verdict, 'allow') AS verdict FROM best"""


@query("op9_url_filters", _url_sql())
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)


# --- Quality rules ---------------------------------------------------------------------------------------------------

@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.learn_from(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


# --- Best-fit packing ------------------------------------------------------------------------------------------------

def packing_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_best_two_fit")
def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), packing_tokenizer())


# --- Secret scans ----------------------------------------------------------------------------------------------------

def _secrets_sql() -> str:
    def spans(kind: int, pattern: str, group: int, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        size = lambda k: f"len(skips[{k}]) + len(hits[{k}])"
        before = f"list_sum(list_transform(range(1, i), lambda k: {size('k')}))"
        start = f"coalesce({before}, 0) + len(skips[i])"
        return f"""(SELECT list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'start': CAST({start} AS BIGINT), 'kind': {kind},
            'end': CAST({start} + len(hits[i]) AS BIGINT), 'value': vals[i]}}), lambda s: len(s.value) >= {least})
          FROM (SELECT regexp_extract_all(body, {p}, 0) AS hits, regexp_extract_all(body, {p}, {group}) AS vals, regexp_split_to_array(body, {p}) AS skips))"""

    base = [spans(k, *spec) for k, (_, *spec) in enumerate(secret_frequency.BASE)]
    names = "[" + ", ".join(f"'{k}'" for k in secret_frequency.KINDS) + "]"
    listed = lambda s: f"coalesce(array_to_string(list_transform({s}, lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || s.end), ','), '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body FROM documents),
hit AS (SELECT *, {base[0]} AS a, {base[1]} AS k, {base[2]} AS h, {spans(3, secret_frequency.RUN, 0, secret_frequency.RUN_LEAST)} AS g FROM docs),
based AS (SELECT *, list_sort(a || k || h) AS base FROM hit),
both_ AS (SELECT *, list_filter(g, lambda x: regexp_matches(x.value, '[0-9]') AND regexp_matches(x.value, '[A-Za-z]')
    AND len(list_filter(base, lambda b: b.start < x.end AND x.start < b.end)) = 0) AS runs FROM based),
each AS (SELECT r, doc_id, source, unnest(base || runs) AS s FROM both_),
owned AS (SELECT s.value AS v, count(DISTINCT coalesce(source, chr(1))) AS n_owners,
    count(DISTINCT {{'owner': source, 'repository': doc_id}}) AS n_repositories FROM each GROUP BY 1),
judged AS (SELECT r, s, n_repositories, CASE WHEN n_owners >= {secret_frequency.WIDE_OWNERS} OR n_repositories >= {secret_frequency.WIDE_REPOSITORIES} THEN 'example'
    WHEN n_owners = 1 AND regexp_matches(s.value, '[0-9]') AND len(list_distinct(string_split(s.value, ''))) >= {secret_frequency.LEAST_DISTINCT} THEN 'live' ELSE 'unclear' END AS verdict
  FROM each JOIN owned ON s.value = v),
kept AS (SELECT r, list_sort(list(s)) AS spans, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_examples,
    max(n_repositories) AS most_repositories FROM judged WHERE s.kind < 3 OR verdict = 'live' GROUP BY r)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(k) AS BIGINT) AS n_access, CAST(len(h) AS BIGINT) AS n_hex,
  sha256({listed('base')}) AS base_sha256, {listed('spans')} AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples,
  coalesce(most_repositories, 0) AS most_repositories FROM both_ LEFT JOIN kept USING (r)"""


@query("op7_secret_frequency", _secrets_sql())
def op7_secret_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_frequency.find_secrets(table(spark, sf_dir, "documents"))
    verdicts = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_frequency.joined(F.col("base")), 256).alias("base_sha256"),
        secret_frequency.joined(F.col("found")).alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("example").alias("n_examples"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["n_repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
    )


# --- Line dedup ------------------------------------------------------------------------------------------------------

@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"), "text")


# --- SimHash near-dedup ----------------------------------------------------------------------------------------------

@query("op3_simhash_trees")
def op3_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trees.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_trees.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


# --- HTML extraction -------------------------------------------------------------------------------------------------

@query("op1_html_density")
def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


# --- Document fingerprints -------------------------------------------------------------------------------------------

@query("op2_multiset_hash")
def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_with_next(table(spark, sf_dir, "documents"))


# --- Language ID -----------------------------------------------------------------------------------------------------

@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.is_held_out(F.col("doc_id")))
    model = language_id.learn(docs.where("not held_out").select("doc_id", "text", "lang"))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


# --- Mixing sources to target weights --------------------------------------------------------------------------------

WEIGHTS = {"good": 0.97, "poor": 0.03, "toxic": 0.0}


@query("op5_soft_mixing")
def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"), WEIGHTS, ["doc_id", "source"])


# --- Target-distribution importance resampling -----------------------------------------------------------------------

def _resampling_sql() -> str:
    """CRC-32 in SQL: a table of 256 numbers made by its rule, then one step a byte, over distinct features only."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    table_of = "b"
    for _ in range(8):
        table_of = f"list_transform([{table_of}], lambda x: {step})[1]"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    byte = "(instr('0123456789ABCDEF', d[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', d[2 * i + 2]) - 1"
    windows = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    k, seed, least, share = importance_resampling.BUCKETS, importance_resampling.SEED, importance_resampling.LEAST_WORDS, importance_resampling.PERCENT
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda b: {table_of}) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
source AS (SELECT r, unnest({windows}) AS f FROM docs),
target AS (SELECT unnest({windows}) AS f FROM (SELECT {words} AS w FROM benchmark)),
spelled AS (SELECT f, hex(encode(f)) AS d FROM (SELECT f FROM source UNION SELECT f FROM target)),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(len(d) // 2), lambda i: {byte}),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {k} AS b FROM spelled, tab),
s AS (SELECT b, count(*) AS n FROM source JOIN hashed USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN hashed USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {k})::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {k})::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
weighed AS (SELECT r, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight, count(*) AS n FROM source JOIN hashed USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {share} // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""


@query("op11_importance_resampling", _resampling_sql())
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# --- Centroid clustering ---------------------------------------------------------------------------------------------

def _clustering_sql() -> str:
    dim, k, scale, seed = ns_clustering.DIM, ns_clustering.K, ns_clustering.SCALE, ns_clustering.SEED
    order = f"sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v"
    steps = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) - 1 AS j, v AS c FROM kept ORDER BY {order} LIMIT {k})"""]
    distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for n in range(ns_clustering.ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': {distance}, 'j': j}}) AS best FROM kept, c{n} GROUP BY r)")
        if n < ns_clustering.ROUNDS:
            steps.append(f"""s{n} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT best.j AS j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY j, i),
m{n} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT j, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (j))""")
    last = ns_clustering.ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON best.j = c{last}.j"""


@query("op12_ns_clustering", _clustering_sql())
def op12_ns_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns_clustering.with_measures(*ns_clustering.cluster_vectors(table(spark, sf_dir, "embeddings")))


# --- N-gram Jaccard join ---------------------------------------------------------------------------------------------

def _jaccard_sql() -> str:
    n, p = ngram_product.WORDS, ngram_product.PERCENT
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) END) AS g FROM docs),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM grams GROUP BY r),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2)
    JOIN sizes s ON s.r = a JOIN sizes t ON t.r = b WHERE 100 * o >= {p} * (s.n + t.n - o)),
reach AS (SELECT r, r AS q FROM docs UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.q = links.a)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM reach JOIN docs d ON reach.r = d.r JOIN docs e ON reach.q = e.r LEFT JOIN sizes s ON s.r = d.r GROUP BY d.r"""


@query("op13_ngram_product", _jaccard_sql())
def op13_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_product.jaccard_components(table(spark, sf_dir, "documents"))
