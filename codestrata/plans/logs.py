"""Queries on usage logs, request streams, graphs and output sizes."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ensure_checkpoints, shared_folder
from ..functions import render as V
from ..operators import graph as G
from ..operators import usage as U
from ..sources import inputs as N
from ..sources import sinks as K
from ..streaming import requests as Q
from .history import read
from .registry import query


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("user_id").alias("project"), F.to_date("ts").alias("day"))


@query("usage_metrics", "SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS projects, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM events GROUP BY event_type")
def usage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("project").alias("projects"))
    return U.with_share(c, []).select("tool", "calls", "projects", "pct")


@query("usage_grouping_sets", """
    SELECT source, project, tool, count(*) AS calls, CAST(grouping(source, project, tool) AS BIGINT) AS level
    FROM (SELECT event_type AS source, user_id AS project, hour(ts) AS tool FROM events) GROUP BY GROUPING SETS ((source), (source, tool), (source, project, tool))
""")
def usage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("project"), F.hour("ts").cast("long").alias("tool"))
    return U.grouping_sets(rows, "source", "project", "tool").withColumn("level", F.col("level").cast("long"))


@query("usage_daily", """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30)
    SELECT day, calls, repeat('█', CAST(floor(calls * 30 / max(calls) OVER ()) AS BIGINT)) AS bar FROM d
""")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.recent(U.counts(calls(spark, sf_dir), ["day"]), "day", 30)


@query("usage_weekly", """
    WITH d AS (SELECT isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, count(*) AS calls FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
    SELECT week, calls, repeat('█', CAST(floor(calls * 30 / max(calls) OVER ()) AS BIGINT)) AS bar FROM d
""")
def usage_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = calls(spark, sf_dir).withColumn("week", U.iso_week(F.col("day")))
    return U.recent(U.counts(weekly, ["week"]), "week", 12)


@query("top_projects", """
    WITH o AS (SELECT user_id AS project, count(*) AS outer_calls FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15),
    p AS (SELECT user_id AS project, event_type AS tool, count(*) AS calls FROM events GROUP BY 1, 2),
    r AS (SELECT p.*, outer_calls, row_number() OVER (PARTITION BY project ORDER BY calls DESC, tool) AS rank FROM p JOIN o USING (project))
    SELECT project, tool, calls, outer_calls, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def top_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.top_nested(calls(spark, sf_dir), "project", "tool", 15, 3).select("project", "tool", "calls", "outer_calls", "rank")


@query("interactions", """
    WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS interaction FROM conversations)
    SELECT conv_id, CAST(interaction AS BIGINT) AS interaction, min(turn) AS first_turn, count(*) AS turns, count(*) FILTER (role <> 'user') AS replies, CAST(sum(length(text)) AS BIGINT) AS chars, max(text) FILTER (role = 'user') AS prompt
    FROM t WHERE interaction > 0 GROUP BY conv_id, interaction HAVING length(max(text) FILTER (role = 'user')) > 0
""")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.interactions(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


EDGE_SQL = "WITH e AS (SELECT * FROM (SELECT conv_id, turn AS seq, role AS caller, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS callee FROM conversations) WHERE callee IS NOT NULL) "


@query("call_groups", EDGE_SQL + "SELECT caller, callee, count(*) AS calls, min(seq) AS first_seq FROM e GROUP BY caller, callee")
def call_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.call_groups(U.call_edges(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role"))


@query("sequence_participants", EDGE_SQL + ", b AS (SELECT seq, 0 AS side, caller AS name FROM e UNION ALL SELECT seq, 1, callee FROM e) SELECT name, min(seq) AS first_seq, CAST(arg_min(side, (seq, side)) AS INTEGER) AS first_side FROM b GROUP BY name")
def sequence_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.participants(U.call_edges(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role"))


@query("closure", """
    WITH RECURSIVE c(src, dst, depth) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey >= 2 UNION ALL SELECT src, dst // 2, depth + 1 FROM c WHERE dst >= 2)
    SELECT src, dst, depth FROM c
""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every part in the tree that halving its number makes."""
    ensure_checkpoints(spark)
    edges = read(spark, sf_dir, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return G.closure(edges)


@query("json_requests", """
    SELECT CASE WHEN event_type = 'purchase' THEN 'refs' WHEN event_type = 'click' THEN 'symbols' ELSE NULL END AS verb,
           CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'click' THEN 'missing_field' WHEN json_valid(props) AND props LIKE '{%' THEN 'unknown_command' ELSE 'invalid_json' END AS error, count(*) AS requests
    FROM events WHERE event_type IN ('purchase', 'click') OR trim(props) <> '' GROUP BY 1, 2
""")
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases ask for references, clicks forget the path, the others send what they carry."""
    line = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("refs").alias("command"), F.col("user_id").cast("string").alias("name")))).when(F.col("event_type") == "click", F.lit('{"command": "symbols"}')).otherwise(F.col("props"))
    rows = Q.parse(read(spark, sf_dir, "events").select(line.alias("value")))
    return rows.groupBy(F.col("request.command").alias("verb"), "error").agg(F.count(F.lit(1)).alias("requests"))


@query("log_turns", """
    SELECT conv_id AS session, CAST(turn AS BIGINT) AS ord, role AS kind, CASE WHEN role = 'user' THEN text END AS prompt, '2025-01-01' AS day FROM conversations WHERE role IN ('user', 'assistant')
""")
def log_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of a log and back."""
    value = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2025-01-01T00:00:00Z").alias("timestamp"), F.struct(F.col("text").alias("content")).alias("message")))
    raw = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("ord"), value.alias("value"))
    return N.log_rows(raw, "agent", F.lit("p")).select("session", "ord", "kind", "prompt", "day")


@query("log_totals", "SELECT 'agent' AS source, count(DISTINCT conv_id) AS files, count(DISTINCT conv_id) FILTER (role = 'user') AS sessions, CAST(0 AS BIGINT) AS calls, count(*) AS records FROM conversations WHERE role IN ('user', 'assistant')")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    raw = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("ord"), value.alias("value"))
    return N.log_totals(N.log_rows(raw, "agent", F.lit("p")))


@query("content_key", "SELECT doc_id, sha256('1' || chr(0) || coalesce(text, '')) AS content_key FROM documents")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", K.content_key(F.col("text")).alias("content_key"))


@query("cache_misses", """
    WITH d AS (SELECT doc_id, sha256('1' || chr(0) || coalesce(text, '')) AS content_key FROM documents), b AS (SELECT DISTINCT sha256('1' || chr(0) || coalesce(text, '')) AS content_key FROM benchmark)
    SELECT content_key, content_key IN (SELECT content_key FROM b) AS hit, min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY 1, 2
""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content, hit where it is among the stored results, which are those of the benchmark's texts."""
    store = K.Store(spark, f"{shared_folder(spark)}/store-{uuid4().hex}")
    store.put(read(spark, sf_dir, "benchmark").select(K.content_key(F.col("text")).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("value")))
    docs = read(spark, sf_dir, "documents").select("doc_id", K.content_key(F.col("text")).alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    hits, misses = store.get(docs)
    found = hits.select("key", F.lit(True).alias("hit")).unionByName(misses.withColumn("hit", F.lit(False)))
    return docs.join(found, "key").select(F.col("key").alias("content_key"), "hit", "doc_id", "copies")


@query("auto_format", """
    WITH r AS (SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
    f AS (SELECT r_name, '[' || string_agg('{"name":"' || n_name || '","key":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']' AS json,
                 '[' || count(*) || ']{name,key}:' || chr(10) || string_agg('  ' || n_name || ',' || n_nationkey, chr(10) ORDER BY n_nationkey) AS toon FROM r GROUP BY r_name),
    m AS (SELECT *, length(json) + 3 * (length(json) - length(replace(json, chr(10), ''))) AS json_cost, length(toon) + 3 * (length(toon) - length(replace(toon, chr(10), ''))) AS toon_cost FROM f)
    SELECT r_name, CAST(json_cost AS INTEGER) AS json_cost, CAST(toon_cost AS INTEGER) AS toon_cost, CASE WHEN toon_cost < json_cost THEN 'toon' ELSE 'json' END AS format FROM m
""")
def auto_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rendering of each region's nations costs less: characters plus three a line; JSON on a tie."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("all"))
    return V.auto(g.withColumn("rows", F.transform("all", lambda x: F.struct(x["name"].alias("name"), x["key"].alias("key")))), "rows", ["name", "key"]).select("r_name", "json_cost", "toon_cost", "format")
