"""Queries on blocks, scopes, structural rules and dispatch.

Each calls its operator; the tables only take the roles of files, ranges, nodes and classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import held
from ..operators import api as A
from ..operators import blocks as B
from ..operators import syntax as Y
from ..operators import twigs as W
from .history import read
from .registry import query


@query("block_extents", r"""
    WITH t AS (SELECT page_id, regexp_extract_all(html, '//[^\n]*|"(?:\\[\s\S]|[^"\\\n])*"?|''(?:\\[\s\S]|[^''\\\n])*''?|[()\[\]{}\n]') AS l FROM pages WHERE html IS NOT NULL),
    k AS (SELECT page_id, unnest(l) AS tok, generate_subscripts(l, 1) AS ord FROM t),
    n AS (SELECT *, sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (length(tok) - length(replace(tok, chr(10), ''))) AS ln FROM k),
    b AS (SELECT page_id, ord, ln, CASE WHEN tok IN ('(', ')') THEN 'paren' WHEN tok IN ('[', ']') THEN 'square' ELSE 'brace' END AS grp, CASE WHEN tok IN ('(', '[', '{') THEN 1 ELSE -1 END AS side
          FROM n WHERE tok IN ('(', ')', '[', ']', '{', '}')),
    s AS (SELECT *, sum(side) OVER (PARTITION BY page_id, grp ORDER BY ord) AS s FROM b),
    m AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id, grp ORDER BY ord)) AS low FROM s),
    v AS (SELECT *, side < 0 AND low < coalesce(lag(low) OVER (PARTITION BY page_id, grp ORDER BY ord), 0) AS void FROM m),
    d AS (SELECT *, s - low + CASE WHEN side < 0 THEN 1 ELSE 0 END AS level FROM v WHERE NOT void),
    p AS (SELECT *, lead(ln) OVER (PARTITION BY page_id, grp, level ORDER BY ord) AS shut FROM d)
    SELECT page_id AS path, grp, count(*) AS blocks, CAST(max(level) AS INTEGER) AS deepest, count(*) FILTER (shut IS NULL) AS unclosed, CAST(coalesce(sum(shut - ln), 0) AS BIGINT) AS lines
    FROM p WHERE side > 0 GROUP BY 1, 2
""")
def block_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are read as one of the lexed languages; what their brackets hold, by page and kind of bracket."""
    files = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("zig").alias("lang"), F.col("html").alias("text"))
    ext = B.extents(B.signed(B.marks(files)))
    lines = F.coalesce(F.sum(F.when(F.col("closed"), F.col("el") - F.col("sl"))), F.lit(0)).alias("lines")
    return ext.groupBy(F.col("path").cast("long").alias("path"), "grp").agg(F.count(F.lit(1)).alias("blocks"), F.max("level").alias("deepest"), F.count(F.when(~F.col("closed"), 1)).alias("unclosed"), lines)


SCOPE_SQL = """
    WITH e AS (SELECT event_id, user_id % 50 AS path, event_type AS name, hour(ts) * 60 + minute(ts) AS lo FROM events),
    s AS (SELECT path, event_id AS scope, name, lo, lo + event_id % 97 AS hi FROM e WHERE event_id % 3 <> 0), u AS (SELECT path, event_id AS use, name, lo AS spot FROM e WHERE event_id % 3 = 0)
"""


@query("scope_bindings", SCOPE_SQL + """,
    j AS (SELECT u.path, use, scope, row_number() OVER (PARTITION BY use ORDER BY hi - lo, scope) AS nth FROM u LEFT JOIN s ON u.path = s.path AND u.name = s.name AND spot BETWEEN lo AND hi)
    SELECT path, use, coalesce(scope, -1) AS scope FROM j WHERE nth = 1
""")
def scope_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are files, types names; two events of three bind theirs from their minute of the day on, the others use it."""
    at = F.hour("ts") * 60 + F.minute("ts")
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("path"), F.col("event_type").alias("name"), at.cast("long").alias("at"))
    scopes = e.where("event_id % 3 <> 0").select("path", F.col("event_id").alias("scope"), "name", F.col("at").alias("lo"), (F.col("at") + F.col("event_id") % 97).alias("hi"))
    uses = e.where("event_id % 3 = 0").select("path", F.col("event_id").alias("use"), "name", "at")
    return Y.scope_of(uses, scopes).select("path", "use", F.coalesce("scope", F.lit(-1)).alias("scope"))


@query("lint_structural", """
    WITH o AS (SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, o_custkey AS path, o_orderpriority AS name FROM orders),
    l AS (SELECT l_orderkey AS k, l_linenumber, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem),
    a AS (SELECT path, 'urgent' AS rule, o.nth AS place FROM o JOIN l ON o.k = l.k WHERE name LIKE '1-%' AND flag = 'R'),
    b AS (SELECT path, 'pair' AS rule, o.nth AS place FROM o JOIN l x ON o.k = x.k JOIN l y ON o.k = y.k WHERE x.flag = 'A' AND y.flag = 'N'),
    c AS (SELECT path, 'deep' AS rule, 0 AS place FROM o JOIN l ON o.k = l.k WHERE flag = 'A')
    SELECT CAST(path AS VARCHAR) AS path, rule AS rule_id, CAST(place AS INTEGER) AS ln, count(*) AS hits FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2, 3
""")
def lint_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are files: a module with a function for every order, named by its priority, and in it a call for every line item, of
    its flag. Rules ask for calls in urgent functions, for pairs of calls in one, and for calls anywhere in the module."""
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = read(spark, sf_dir, "lineitem").withColumn("at", F.row_number().over(by)).select(F.col("l_orderkey").alias("o_orderkey"), "at", F.col("l_returnflag").alias("flag"))
    sizes = items.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("size"))
    # No side is broadcast: the tables are as large as the input, whatever their compressed files let Spark expect.
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("path"), F.col("o_orderpriority").alias("name"))
    o = o.join(sizes.hint("merge"), "o_orderkey", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    nth = Window.partitionBy("path").orderBy("o_orderkey")
    o = o.withColumns({"nth": F.row_number().over(nth), "id": (F.coalesce(F.sum(F.col("size") + 1).over(nth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int")})
    o = held(o, "orders")
    shape = lambda df, id_, last, parent, kind, name, field, ln: df.select("path", id_.cast("int").alias("id"), last.cast("int").alias("last"), parent.cast("int").alias("parent"), F.lit(kind).alias("kind"), name.alias("name"), F.lit(field).alias("field"), ln.cast("int").alias("sl"), F.lit(0).alias("sc"), F.lit("").alias("preview"))
    modules = shape(o.groupBy("path").agg(F.max(F.col("id") + F.col("size")).alias("end")), F.lit(0), F.col("end"), F.lit(None), "Module", F.lit(None).cast("string"), None, F.lit(0))
    functions = shape(o, F.col("id"), F.col("id") + F.col("size"), F.lit(0), "FunctionDef", F.col("name"), "body", F.col("nth"))
    calls = o.join(items.hint("merge"), "o_orderkey")
    calls = shape(calls, F.col("id") + F.col("at"), F.col("id") + F.col("at"), F.col("id"), "Call", F.col("flag"), "body", F.col("nth"))
    nodes = modules.unionByName(functions).unionByName(calls)
    rules = spark.createDataFrame([
        ("urgent", "python", "error", "m", '(FunctionDef body: (Call) @c (#eq? @c "R")) @f (#match? @f "^1-")', None),
        ("pair", "python", "error", "m", '(FunctionDef (Call) @a (Call) @b (#eq? @a "A") (#eq? @b "N")) @f', None),
        ("deep", "python", "info", "m", '(Module ..(Call) @c (#eq? @c "A")) @m', None),
    ], "id string, language string, severity string, message string, query string, pattern string")
    found, _ = W.lint(nodes, rules)
    return found.where("capture in ('f', 'm')").groupBy("path", "rule_id", "ln").agg(F.count(F.lit(1)).alias("hits"))


DISPATCH_SQL = """
    WITH RECURSIVE uses AS (SELECT p_partkey AS class, p_partkey * 2 AS trait FROM part WHERE p_size > 10 UNION SELECT p_partkey, p_partkey * 3 FROM part WHERE p_size > 40 UNION SELECT s_suppkey * 16, s_suppkey FROM supplier WHERE s_nationkey < 3),
    targets AS (SELECT p_partkey AS type, 'm' || p_size % 3 AS method FROM part WHERE p_size > 44), declared AS (SELECT p_partkey AS class, 'm' || p_size % 3 AS method FROM part WHERE p_size BETWEEN 11 AND 14),
    unclear AS (SELECT p_partkey AS class FROM part WHERE p_size = 20), calls AS (SELECT DISTINCT p_partkey AS class, 'm' || p_partkey % 3 AS method FROM part),
    shut AS (SELECT type AS node, method FROM targets UNION SELECT class, method FROM declared),
    w(class, method, node) AS (SELECT class, method, class FROM calls UNION SELECT w.class, w.method, trait FROM w JOIN uses ON uses.class = w.node WHERE NOT EXISTS (SELECT 1 FROM shut WHERE shut.node = w.node AND shut.method = w.method)),
    o AS (SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM uses WHERE uses.class = w.node) AND NOT EXISTS (SELECT 1 FROM shut WHERE shut.node = w.node AND shut.method = w.method)),
    e AS (SELECT DISTINCT o.method, o.node AS a, trait AS b FROM o JOIN uses ON uses.class = o.node),
    r(method, a, b) AS (SELECT method, a, b FROM e UNION SELECT r.method, r.a, e.b FROM r JOIN e ON r.method = e.method AND r.b = e.a),
    cyc AS (SELECT DISTINCT method, a AS node FROM r WHERE a = b),
    d AS (SELECT DISTINCT o.class, o.method FROM o WHERE o.node IN (SELECT class FROM unclear) UNION SELECT o.class, o.method FROM o JOIN cyc ON cyc.method = o.method AND cyc.node = o.node),
    h AS (SELECT w.class, w.method, min(type) AS t, count(DISTINCT type) AS n FROM w LEFT JOIN targets ON type = w.node AND targets.method = w.method GROUP BY 1, 2)
"""


@query("trait_dispatch", DISPATCH_SQL + """
    SELECT h.class, h.method, CASE WHEN n = 0 THEN 'none' WHEN n > 1 OR d.class IS NOT NULL THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN n = 1 AND d.class IS NULL THEN t ELSE -1 END AS target
    FROM h LEFT JOIN d ON d.class = h.class AND d.method = h.method
""")
def trait_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are classes and traits: they use those of twice and three times their number, suppliers close cycles."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    pair = lambda df, a, b: df.select(a.alias("class"), b.alias("trait"))
    supplier = read(spark, sf_dir, "supplier").where("s_nationkey < 3")
    uses = pair(part.where("p_size > 10"), k, k * 2).unionByName(pair(part.where("p_size > 40"), k, k * 3)).unionByName(pair(supplier, F.col("s_suppkey") * 16, F.col("s_suppkey")))
    method = F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string"))
    targets = part.where("p_size > 44").select(k.alias("type"), method.alias("method"))
    declared = part.where("p_size between 11 and 14").select(k.alias("class"), method.alias("method"))
    calls = part.select(k.alias("class"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("method"))
    found = A.trait_dispatch(calls, targets, uses, declared, part.where("p_size = 20").select(k.alias("class")))
    return found.select("class", "method", "state", F.coalesce("target", F.lit(-1)).alias("target"))
