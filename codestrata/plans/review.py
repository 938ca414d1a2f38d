"""Queries on liveness, interface snapshots, renames, ranges and routes.

A line item refers to a part if its quantity is the part's size (by the part alone, every part is referenced and nothing
is ever dead): flag R stands for test code, others for other code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import liveness as L
from ..operators import references as R
from ..operators import snapshots as S
from .history import read
from .registry import query

LIVE_SQL = """
    WITH refs AS (SELECT l_partkey AS key, l_returnflag = 'R' AS is_test FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity = p_size),
    counts AS (SELECT key, count(*) FILTER (NOT is_test) AS prod, count(*) FILTER (is_test) AS test FROM refs GROUP BY key),
    cls AS (SELECT p_partkey AS key, p_name AS name, p_brand AS file, p_size AS line, coalesce(prod, 0) AS prod, coalesce(test, 0) AS test,
                   CASE WHEN coalesce(prod, 0) > 0 THEN 'live' WHEN coalesce(test, 0) > 0 THEN 'test-only' ELSE 'dead' END AS status
            FROM part LEFT JOIN counts ON p_partkey = key)
"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("l_quantity"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("double").alias("l_quantity"), (F.col("l_returnflag") == "R").alias("is_test"))
    return rows.join(parts, ["key", "l_quantity"], "left_semi").select("key", "is_test")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"))
    return L.classify(parts, L.reference_counts(references(spark, sf_dir)))


@query("dead_symbols", LIVE_SQL + "SELECT key, name, prod, test, status FROM cls")
def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("key", "name", "prod", "test", "status")


@query("liveness_by_type", LIVE_SQL + "SELECT file, status, count(*) AS symbols FROM cls GROUP BY file, status")
def liveness_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy("file", "status").agg(F.count(F.lit(1)).alias("symbols"))


@query("duplicate_guard", """
    WITH refs AS (SELECT p_name AS key, l_returnflag = 'R' AS is_test FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity = p_size),
    counts AS (SELECT key, count(*) FILTER (NOT is_test) AS prod, count(*) FILTER (is_test) AS test FROM refs GROUP BY key),
    c AS (SELECT p_partkey AS id, p_name AS key, count(*) OVER (PARTITION BY p_name) AS key_count FROM part)
    SELECT id, c.key, key_count, coalesce(prod, 0) AS prod, coalesce(test, 0) AS test,
           CASE WHEN key_count > 1 THEN 'duplicate' WHEN coalesce(prod, 0) > 0 THEN 'live' WHEN coalesce(test, 0) > 0 THEN 'test-only' ELSE 'dead' END AS status
    FROM c LEFT JOIN counts ON c.key = counts.key
""")
def duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several parts bear cannot be told apart by their references."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key"))
    refs = references(spark, sf_dir).withColumnRenamed("key", "k").join(parts, F.col("k") == F.col("id")).select("key", "is_test")
    return L.classify(parts, L.reference_counts(refs)).select("id", "key", "key_count", "prod", "test", "status")


@query("dead_touched", LIVE_SQL + ", added AS (SELECT DISTINCT p_brand AS file, CAST(l_quantity AS INTEGER) AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1998-11-01') SELECT key, file, line FROM cls WHERE status = 'dead' AND EXISTS (SELECT 1 FROM added a WHERE a.file = cls.file AND a.line = cls.line)")
def dead_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead parts whose (brand, size) is an added (brand, quantity) line of the last shipments."""
    late = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-11-01").cast("timestamp_ntz"))
    brands = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    added = late.join(brands, "l_partkey").select("file", F.col("l_quantity").cast("int").alias("line"))
    return L.touched(classified(spark, sf_dir).where("status = 'dead'"), added).select("key", "file", "line")


@query("dead_wip", LIVE_SQL + ", added AS (SELECT DISTINCT p_brand AS file, p_name AS name FROM part WHERE p_retailprice > 1500) SELECT key, file, name FROM cls WHERE status = 'dead' AND NOT EXISTS (SELECT 1 FROM added a WHERE a.file = cls.file AND a.name = cls.name)")
def dead_wip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead parts that the change (parts above 1500) does not itself add."""
    added = read(spark, sf_dir, "part").where("p_retailprice > 1500").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"))
    return L.without_added(classified(spark, sf_dir).where("status = 'dead'"), added).select("key", "file", "name")


SNAP_SQL = """
    WITH s AS (SELECT year(o_orderdate) < 1998 AS early, o_custkey || '-' || month(o_orderdate) AS name, max(o_orderpriority) AS signature FROM orders GROUP BY 1, 2),
    o AS (SELECT * FROM s WHERE early), n AS (SELECT * FROM s WHERE NOT early)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders: those before 1998 are the old side, the others the new one; a customer's month is a name."""
    name = F.concat_ws("-", "o_custkey", F.month("o_orderdate"))
    orders = read(spark, sf_dir, "orders").select((F.year("o_orderdate") < 1998).alias("early"), name.alias("name"), F.col("o_orderpriority").alias("s"))
    of = lambda early: orders.where(F.col("early") == early).groupBy("name").agg(F.max("s").alias("signature"))
    return of(True), of(False)


@query("api_snapshot_diff", SNAP_SQL + """
    SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'modified' END AS change, o.signature AS old_signature, n.signature AS new_signature
    FROM o FULL JOIN n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.signature <> n.signature
""")
def api_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.diff(*snapshots(spark, sf_dir))


@query("api_moves", SNAP_SQL + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY name) AS nth FROM o WHERE name NOT IN (SELECT name FROM n)),
    a AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY name) AS nth FROM n WHERE name NOT IN (SELECT name FROM o))
    SELECT r.signature, r.name AS from_name, a.name AS to_name FROM r JOIN a ON r.signature = a.signature AND r.nth = a.nth
""")
def api_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th removed name of a signature moved to the k-th added one."""
    old, new = snapshots(spark, sf_dir)
    moved, _, _ = S.moves(old.join(new, "name", "left_anti"), new.join(old, "name", "left_anti"), ["signature"], ["name"])
    return moved


@query("rename_pairs", """
    WITH d AS (SELECT doc_id AS id, lang, n_chars AS size, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'))), ' ')) AS exports FROM documents),
    e AS (SELECT a.id AS deleted_id, b.id AS untracked_id FROM d a JOIN d b ON a.lang = b.lang AND a.exports = b.exports AND greatest(a.size, b.size) <= 2 * least(a.size, b.size) WHERE a.id % 2 = 0 AND b.id % 2 = 1)
    SELECT deleted_id, untracked_id FROM (SELECT *, count(*) OVER (PARTITION BY deleted_id) AS x, count(*) OVER (PARTITION BY untracked_id) AS y FROM e) WHERE x = 1 AND y = 1
""")
def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents are deleted files, odd ones untracked; what a file exports is its set of words."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1))))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("size"), F.md5(F.array_join(words, " ").cast("binary")).alias("exports"))
    return S.mutual_unique(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"))




def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranges of days within an order. Equal ranges of an order are one, so (path, lo, hi) is a key."""
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400).cast("long")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), day.alias("lo"), (day + F.col("l_quantity").cast("long")).alias("hi"), (F.col("l_returnflag") == "R").alias("outer"))
    return rows.groupBy("path", "lo", "hi").agg(F.bool_or("outer").alias("outer")).withColumn("id", F.concat_ws("-", "lo", "hi"))


RANGE_SQL = """
    WITH r AS (SELECT path, lo, hi, bool_or(flag = 'R') AS is_outer, lo || '-' || hi AS id FROM (
        SELECT l_orderkey AS path, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS lo, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(l_quantity AS BIGINT) AS hi, l_returnflag AS flag FROM lineitem) GROUP BY path, lo, hi)
"""


@query("container_innermost", RANGE_SQL + """,
    j AS (SELECT i.path, i.id, i.lo, i.hi, o.id AS container, o.hi - o.lo AS height, row_number() OVER (PARTITION BY i.path, i.id ORDER BY o.hi - o.lo, o.id) AS nth
          FROM r i LEFT JOIN r o ON o.is_outer AND i.path = o.path AND o.lo <= i.lo AND o.hi >= i.hi AND o.id <> i.id)
    SELECT path, id, lo, hi, coalesce(container, '') AS container, coalesce(height, -1) AS container_height FROM j WHERE nth = 1
""")
def container_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    found = I.innermost(r.select("path", "id", "lo", "hi"), r.where("outer"))
    return found.withColumns({"container": F.coalesce("container", F.lit("")), "container_height": F.coalesce("container_height", F.lit(-1))})


@query("affected_by_hunk", RANGE_SQL + """,
    h AS (SELECT o_orderkey AS path, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 3 AS new_start, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 30 END AS BIGINT) AS new_count, CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 5 END AS BIGINT) AS old_count FROM orders),
    j AS (SELECT r.path, r.id, lo, hi, greatest(new_start - 1, 0) AS hs, new_count AS n, old_count FROM r JOIN h ON r.path = h.path
          AND CASE WHEN new_count = 0 THEN lo <= greatest(new_start - 1, 0) AND greatest(new_start - 1, 0) < hi ELSE greatest(new_start - 1, 0) <= hi AND greatest(new_start - 1, 0) + new_count > lo END)
    SELECT path, id, CASE WHEN n = 0 THEN 'removed' WHEN hs <= lo AND hs + n > hi AND old_count + 25 = n THEN 'added'
           WHEN old_count = 0 THEN CASE WHEN hs <= lo AND hs + n > hi THEN 'added' ELSE 'modified' END ELSE 'modified' END AS change FROM j
""")
def affected_by_hunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are hunks of 30 new days (none when finished) that start two days after the order."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    hunks = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path"), F.lit(0).alias("hunk"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(5).cast("long").alias("old_count"), (day + 3).alias("new_start"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(30).cast("long").alias("new_count"), F.lit(25).cast("long").alias("added_in_hunk"),
    )
    symbols = ranges(spark, sf_dir).select("path", "id", F.col("lo").alias("sl"), F.col("hi").alias("el"))
    return I.affected(symbols, hunks).select("path", "id", "change")


@query("touched_semi", RANGE_SQL + ", a AS (SELECT o_orderkey AS path, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 10 AS line FROM orders) SELECT path, id FROM r WHERE EXISTS (SELECT 1 FROM a WHERE a.path = r.path AND a.line BETWEEN r.lo AND r.hi)")
def touched_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    added = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (day + 10).alias("line"))
    return I.touched(ranges(spark, sf_dir).select("path", "id", F.col("lo").alias("sl"), F.col("hi").alias("el")), added).select("path", "id")


TOKEN_SQL = r"""
    WITH parts AS (SELECT doc_id AS key, lang, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    trimmed AS (SELECT key, lang, CASE WHEN len(l) > 1 AND l[-1] = '' THEN l[:-2] ELSE l END AS l FROM parts),
    lines AS (SELECT key, lang, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ln FROM trimmed),
    tok AS (SELECT key, lang, ln, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM lines)
"""
NAMES = ["the", "ing", "und", "que", "BENCHMARK", "License"]


@query("refs_batch", TOKEN_SQL + "SELECT key, ln, name, count(*) AS hits FROM tok WHERE name IN ('the', 'ing', 'und', 'que', 'BENCHMARK', 'License') GROUP BY key, ln, name")
def refs_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(read(spark, sf_dir, "documents"), "doc_id", "text", NAMES)


@query("refs_counts", TOKEN_SQL + ", q AS (SELECT unnest(['the', 'ing', 'und', 'que', 'BENCHMARK', 'License']) AS name) SELECT q.name, count(tok.name) AS refs, count(DISTINCT tok.key) AS files FROM q LEFT JOIN tok ON q.name = tok.name GROUP BY q.name")
def refs_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requested name has a row, referenced or not."""
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = R.search(read(spark, sf_dir, "documents"), "doc_id", "text", NAMES).groupBy("name").agg(F.sum("hits").alias("refs"), F.countDistinct("key").alias("files"))
    return names.join(found, "name", "left").select("name", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("files", F.lit(0)).alias("files"))


@query("lint_substring", TOKEN_SQL + """, rules(id, language, severity, pattern) AS (VALUES ('R1', 'en', 'error', 'tionly'), ('R2', 'en', 'warning', 'ingthe'), ('R3', 'de', 'warning', 'ungsch'), ('R4', 'fr', 'error', 'eaux'))
    SELECT id AS rule_id, severity, key, ln, name FROM tok JOIN rules ON lang = language AND contains(name, pattern)""")
def lint_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("R1", "en", "error", "tionly"), ("R2", "en", "warning", "ingthe"), ("R3", "de", "warning", "ungsch"), ("R4", "fr", "error", "eaux")], "id string, language string, severity string, pattern string")
    return R.lint(read(spark, sf_dir, "documents"), "doc_id", "text", "lang", rules)


@query("line_snippet", TOKEN_SQL + """,
    spot AS (SELECT key, min(ln) AS pos FROM tok WHERE name = 'the' GROUP BY key),
    near AS (SELECT l.key, pos, ln, (CASE WHEN ln = pos THEN '> ' ELSE '  ' END) || lpad(CAST(ln + 1 AS VARCHAR), CAST(length(CAST(pos + 4 AS VARCHAR)) AS INTEGER), ' ') || ' | ' || line AS t
             FROM lines l JOIN spot ON l.key = spot.key AND ln BETWEEN pos - 3 AND pos + 3)
    SELECT key, pos, string_agg(t, chr(10) ORDER BY ln) AS snippet FROM near GROUP BY key, pos
""")
def line_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines around the first line with the word "the"."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    at = R.search(docs, "doc_id", "text", ["the"]).groupBy("key").agg(F.min("ln").alias("at"))
    return I.snippet(R.lines(docs, "doc_id", "text").withColumnRenamed("line", "text"), at).withColumnRenamed("at", "pos")
