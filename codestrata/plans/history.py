"""Queries on co-change and commit history. Roles: an order is a commit, the types of its parts are the files it
changes, its customer the author, its date the time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CoChangeConfig
from ..operators import cochange as C
from ..operators.dealing import deal, parts
from .registry import query

CONFIG = CoChangeConfig(pivot=2)
STRICT = replace(CONFIG, min_confidence=0.48, per_source_limit=3)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(evidence, commit_files, parts)."""
    items = read(spark, sf_dir, "lineitem")
    n = parts(items)
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("path"))
    typed = deal(items.select("l_orderkey", "l_partkey"), n, "l_partkey").join(deal(part, n, "l_partkey"), "l_partkey")
    files = deal(typed.select(F.col("l_orderkey").alias("sha"), "path"), n, "sha").distinct()
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").cast("string").alias("author_mail"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("author_time"))
    return files.join(deal(orders, n, "sha"), "sha").select(F.col("path").alias("source"), "sha", "author_mail", "author_time"), files, n


BASE_SQL = """
    WITH files AS (SELECT DISTINCT l_orderkey AS sha, p_type AS path FROM lineitem JOIN part ON l_partkey = p_partkey),
    ev AS (SELECT path AS source, sha, CAST(o_custkey AS VARCHAR) AS mail, CAST(floor(epoch(o_orderdate) / 604800) AS BIGINT) AS span FROM files JOIN orders ON sha = o_orderkey),
    sizes AS (SELECT sha, count(*) AS n FROM files GROUP BY sha),
    used AS (SELECT DISTINCT ev.*, CASE WHEN n > 100 THEN 0 ELSE least(1.0, sqrt(2.0 / greatest(n, 1))) END AS w FROM ev JOIN sizes USING (sha)),
    per_source AS (SELECT source, count(DISTINCT sha) AS den, count(DISTINCT mail || '/' || span) AS units FROM used WHERE w > 0 GROUP BY source),
    pairs AS (SELECT source, path AS candidate, count(DISTINCT used.sha) AS co, count(DISTINCT mail || '/' || span) AS co_units
              FROM used JOIN files USING (sha) WHERE path <> source AND w > 0 GROUP BY source, path),
    scored AS (SELECT p.*, den, units, (SELECT count(DISTINCT e.sha) FROM ev e WHERE e.source = p.source) AS total_a, (SELECT count(*) FROM files f WHERE f.path = p.candidate) AS total_b,
                      co / den AS confidence, (co_units + 1.0) / (units + 9.0) AS score
               FROM pairs p JOIN per_source USING (source)),
    staged AS (SELECT *, CASE WHEN co < 2 OR den < 2 THEN 'samples' WHEN confidence < {conf} THEN 'confidence' END AS stage FROM scored),
    ranked AS (SELECT *, CASE WHEN stage IS NULL THEN row_number() OVER (PARTITION BY source, stage IS NULL ORDER BY score DESC, co DESC, confidence DESC, candidate) END AS rank FROM staged)
"""
PAIR_SQL = BASE_SQL + """
    SELECT source AS file_a, candidate AS file_b, CAST(co AS BIGINT) AS co, CAST(den AS BIGINT) AS den, CAST(total_a AS BIGINT) AS total_changes_a, CAST(total_b AS BIGINT) AS total_changes_b,
           round(confidence, 9) AS confidence, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE stage IS NULL AND rank <= {limit}
"""


def pairs(spark: SparkSession, sf_dir: str, config: CoChangeConfig) -> DataFrame:
    evidence, files, n = tables(spark, sf_dir)
    found = C.ranked(C.candidates(evidence, files, config, exclude_all_sources=False, parts=n), config)
    return found.select(
        F.col("source").alias("file_a"), F.col("candidate").alias("file_b"), "co", "den", "total_changes_a", "total_changes_b", F.round("confidence", 9).alias("confidence"), F.round("score", 9).alias("score"), "rank"
    )


@query("cochange_pairs", PAIR_SQL.format(conf=0.3, limit=10))
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, CONFIG)


@query("cochange_strict", PAIR_SQL.format(conf=0.48, limit=3))
def cochange_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, STRICT)


@query("cochange_diagnostics", BASE_SQL.format(conf=0.48) + """
    SELECT count(*) AS candidates, count(*) FILTER (stage = 'samples') AS failed_samples, count(*) FILTER (stage = 'confidence') AS failed_confidence,
           CAST(0 AS BIGINT) AS failed_score, count(*) FILTER (rank <= 3) AS returned, count(*) FILTER (rank > 3) AS truncated FROM ranked
""")
def cochange_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, files, n = tables(spark, sf_dir)
    return C.diagnostics(C.candidates(evidence, files, STRICT, exclude_all_sources=False, parts=n), STRICT)


@query("missing_cochange", BASE_SQL.format(conf=0.3) + """,
    big AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1),
    changed AS (SELECT path FROM files WHERE sha IN (SELECT o_orderkey FROM big)),
    one AS (SELECT CASE WHEN a THEN candidate ELSE source END AS file, CASE WHEN a THEN source ELSE candidate END AS expected_with, confidence
            FROM (SELECT *, source IN (SELECT path FROM changed) AS a, candidate IN (SELECT path FROM changed) AS b FROM ranked WHERE stage IS NULL AND rank <= 10) WHERE a <> b),
    best AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, expected_with) AS nth FROM one)
    SELECT file, expected_with, round(confidence, 9) AS confidence FROM best WHERE nth = 1 ORDER BY best.confidence DESC, file, expected_with LIMIT 10
""")
def missing_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed set is the largest order's."""
    evidence, files, n = tables(spark, sf_dir)
    found = C.ranked(C.candidates(evidence, files, CONFIG, exclude_all_sources=False, parts=n), CONFIG)
    big = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), "o_totalprice").orderBy(F.desc("o_totalprice"), "sha").limit(1)
    changed = files.join(F.broadcast(big.select("sha")), "sha").select("path")  # one row
    return C.missing(found, changed).select("file", "expected_with", F.round("confidence", 9).alias("confidence"))


HISTORY_SQL = """
    WITH touches AS (SELECT DISTINCT l_partkey AS path, o_orderkey AS sha, epoch_us(o_orderdate) AS ord, o_orderstatus = 'P' AS is_merge FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord DESC, sha DESC) AS nth FROM touches) WHERE nth <= 20)
"""


def touches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """((path, sha, ord, is_merge) by sha, parts)."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("sha"))
    n = parts(items)
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ord"), (F.col("o_orderstatus") == "P").alias("is_merge"))
    return deal(items, n, "sha").distinct().join(deal(orders, n, "sha"), "sha"), n


@query("merge_filtered_evidence", HISTORY_SQL + "SELECT path, count(*) AS commits, count(*) FILTER (NOT is_merge) AS kept, max(ord) FILTER (NOT is_merge) AS last FROM recent GROUP BY path")
def merge_filtered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 commits of each file, merges taken out."""
    t, n = touches(spark, sf_dir)
    merges = t.where("is_merge").select("sha").distinct()
    recent = C.history(t, CONFIG.history_limit, n)
    kept = deal(deal(recent, n, "sha").join(merges, "sha", "left_anti"), n, "path").groupBy("path").agg(F.count(F.lit(1)).alias("kept"), F.max("ord").alias("last"))
    return recent.groupBy("path").agg(F.count(F.lit(1)).alias("commits")).join(kept, "path", "left").select("path", "commits", F.coalesce("kept", F.lit(0)).alias("kept"), "last")


@query("evidence_fallback", HISTORY_SQL + """,
    blame AS (SELECT DISTINCT l_partkey AS source, l_orderkey AS sha FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40),
    past AS (SELECT path AS source, sha FROM recent WHERE NOT is_merge),
    n AS (SELECT source, coalesce(b, 0) AS b, coalesce(h, 0) AS h FROM (SELECT source, count(*) AS b FROM blame GROUP BY source) FULL JOIN (SELECT source, count(*) AS h FROM past GROUP BY source) USING (source))
    SELECT source, CASE WHEN b < 2 AND h > b THEN 'history' ELSE 'blame' END AS mode, CAST(CASE WHEN b < 2 AND h > b THEN h ELSE b END AS BIGINT) AS commits FROM n
""")
def evidence_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blame = returned lines of 40 pieces or more; history where that gives fewer than two commits."""
    t, n = touches(spark, sf_dir)
    past = deal(C.history(t, CONFIG.history_limit, n), n, "sha").join(t.where("is_merge").select("sha").distinct(), "sha", "left_anti").select(F.col("path").alias("source"), "sha")
    blame = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 40").select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("sha"))
    return C.choose_evidence(blame, past, CONFIG.min_denominator, n).groupBy("source", "mode").agg(F.count(F.lit(1)).alias("commits"))
