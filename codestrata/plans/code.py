"""Queries on routes, interfaces, members, inputs and lexed text.

Each calls its operator; the tables only take the roles of files, symbols and references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conventions as C
from ..operators import api as A
from ..operators import impact as M
from ..operators import lexing as X
from ..operators import liveness as L
from ..operators import syntax as Y
from ..operators.dealing import deal, parts
from ..sources import diffs as D
from ..sources import inputs as N
from .history import read
from .registry import query

LINES = "(SELECT *, ['AIR', 'MAIL', 'SHIP', 'RAIL'][1 + l_suppkey % 4] AS l_shipmode, l_linestatus AS l_shipinstruct FROM lineitem) lineitem"


def ask(name: str, sql: str):
    """A query whose SQL sees line items with the file that ``items`` gives them."""
    return query(name, sql.replace("FROM lineitem", f"FROM {LINES}"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; the supplier gives the file that one stands in."""
    mode = F.element_at(F.array(*map(F.lit, ("AIR", "MAIL", "SHIP", "RAIL"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").withColumns({"l_shipmode": mode, "l_shipinstruct": F.col("l_linestatus")})


@ask("attribute_refs", r"""
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:^|[^A-Za-z0-9_:.-])(?:android:name|tools:context|android:onClick|app:layout_behavior|class)[ \t]*=[ \t]*("[^"]*"|''[^'']*'')', 1)) AS q FROM pages WHERE strlen(html) <= 1048576),
    t AS (SELECT page_id, rtrim(unnest(regexp_extract_all(html, '<([A-Za-z_][A-Za-z0-9_.]*)', 1)), '.') AS v FROM pages WHERE strlen(html) <= 1048576),
    v AS (SELECT page_id, substr(q, 2, length(q) - 2) AS v FROM a UNION ALL SELECT page_id, v FROM t WHERE contains(v, '.')),
    p AS (SELECT page_id, regexp_replace(trim(unnest(string_split_regex(v, '[#$]'))), '^\.+', '') AS c FROM v),
    n AS (SELECT page_id, c AS name FROM p UNION SELECT page_id, string_split(c, '.')[-1] FROM p)
    SELECT name, count(DISTINCT page_id) AS pages FROM n WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') GROUP BY name
""")
def attribute_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages name by the attributes that name code."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    return C.xml_references(pages).groupBy("name").agg(F.countDistinct("path").alias("pages"))


ROUTE_SQL = """
    WITH r AS (SELECT CAST(user_id AS VARCHAR) AS path, hour(ts) AS line, CAST(CAST(ts AS DATE) AS VARCHAR) AS symbol,
                      min(CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS rank FROM events GROUP BY 1, 2, 3),
    s AS (SELECT path, line, CASE rank WHEN 0 THEN 'normal' WHEN 1 THEN 'low' ELSE 'informational' END AS route, list_sort(list(symbol)) AS symbols FROM r GROUP BY path, line, rank)
"""


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are files, hours lines, days symbols; a click is a bare reference to a common name, what is neither
    purchase nor click an import of a modified symbol."""
    e, kind = read(spark, sf_dir, "events"), F.col("event_type")
    no = F.lit(False)
    flags = {
        "is_import": ~kind.isin("purchase", "click"), "change": F.lit("modified"), "function_value": no, "same_arity": no, "reexport_move": no, "confidence": F.when(kind == "click", "bare").otherwise("exact"),
        "name": F.lit("Add"), "ref_lang": F.lit("php"), "owner": F.lit(None).cast("string"), "direct_import": F.lit(None).cast("boolean"), "local_shadow": no, "macro_callee": no, "in_macro": no, "has_evidence": no,
    }
    rows = e.select(F.col("user_id").cast("string").alias("path"), F.hour("ts").cast("long").alias("line"), F.to_date("ts").cast("string").alias("symbol"), kind, F.lit("c").alias("caller")).withColumns(flags)
    return M.settle(rows.withColumn("route", M.route(X.GENERIC_NAMES)))


@ask("caller_route", ROUTE_SQL + "SELECT path, line, route, len(symbols) AS symbols, symbols[1] AS first_symbol FROM s")
def caller_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, sf_dir).select("path", "line", "route", F.size("symbols").cast("long").alias("symbols"), F.element_at("symbols", 1).alias("first_symbol"))


@ask("bucket_precedence", ROUTE_SQL + "SELECT route, count(*) AS places, CAST(sum(len(symbols)) AS BIGINT) AS symbols FROM s GROUP BY route")
def bucket_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, sf_dir).groupBy("route").agg(F.count(F.lit(1)).alias("places"), F.sum(F.size("symbols")).alias("symbols"))


CHANGED_SQL = "c AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events WHERE event_type = 'click' AND hour(ts) < 2)"


@ask("unresolved_anti", ROUTE_SQL + ", " + CHANGED_SQL + " SELECT path, count(DISTINCT symbol) AS symbols FROM (SELECT path, unnest(symbols) AS symbol FROM s WHERE route = 'normal' AND path NOT IN (SELECT path FROM c)) GROUP BY path")
def unresolved_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unresolved(spark, sf_dir).select("path", F.size("symbols").cast("long").alias("symbols"))


@ask("impact_groups", ROUTE_SQL + ", " + CHANGED_SQL + ", u AS (SELECT path, list_sort(list(DISTINCT symbol)) AS symbols FROM (SELECT path, unnest(symbols) AS symbol FROM s WHERE route = 'normal' AND path NOT IN (SELECT path FROM c)) GROUP BY path) SELECT path, array_to_string(symbols, ',') AS symbols FROM u")
def impact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unresolved(spark, sf_dir).select("path", F.array_join("symbols", ",").alias("symbols"))


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = read(spark, sf_dir, "events").where((F.col("event_type") == "click") & (F.hour("ts") < 2)).select(F.col("user_id").cast("string").alias("path"))
    return M.unresolved(settled(spark, sf_dir), changed)


@ask("signature_change", """
    WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, 'fn order(' || o_orderpriority || ')' AS line, o_orderstatus AS s, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS day, o_orderkey AS k FROM orders),
    f AS (SELECT path, arg_min(line, (day, k)) FILTER (s = 'F') AS old_line, arg_min(line, (day, k)) FILTER (s = 'O') AS new_line FROM o GROUP BY path)
    SELECT path, 'order' AS name, old_line, new_line FROM f WHERE old_line <> new_line
""")
def signature_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are removed lines of a customer's file, open ones added lines."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    lines = o.select(
        F.lit("d").alias("diff_id"), F.col("o_custkey").cast("string").alias("new_path"), day.alias("hunk"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("tag"),
        F.concat(F.lit("fn order("), "o_orderpriority", F.lit(")")).alias("text"),
    )
    lines = deal(lines, parts(read(spark, sf_dir, "orders")), "new_path")
    return D.signature_changes(lines, spark.createDataFrame([("order",)], "name string")).drop("diff_id")


REF_SQL = "r AS (SELECT l_shipmode AS path, l_partkey AS name, l_linenumber AS ln, l_returnflag = 'R' AS imp, l_returnflag = 'A' AND l_linenumber = 1 AS def, l_suppkey AS supp, l_returnflag AS flag FROM lineitem)"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship modes are files, line items references to their part; those with flag R are imports, some with A definitions."""
    f = F.col("l_returnflag")
    return items(spark, sf_dir).select(F.col("l_shipmode").alias("path"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("ln"), (f == "R").alias("is_import"), ((f == "A") & (F.col("l_linenumber") == 1)).alias("is_definition"), F.col("l_suppkey").alias("supp"), f.alias("flag"))


@ask("api_reference_index", f"""
    WITH {REF_SQL}, a AS (SELECT DISTINCT l_shipmode AS path, l_linenumber AS ln FROM lineitem WHERE l_linenumber <= 3),
    j AS (SELECT p_partkey AS name, 'AIR' AS file, r.path, coalesce(imp, false) AS imp, coalesce(def, false) AS def, a.ln IS NOT NULL AS on_added FROM part LEFT JOIN r ON p_partkey = r.name LEFT JOIN a ON r.path = a.path AND r.ln = a.ln),
    g AS (SELECT name, file, count(*) FILTER (path = file AND NOT def AND NOT imp) AS internal, count(*) FILTER (path <> file AND NOT def) AS external, count(*) FILTER (def) AS defined,
                 count(*) FILTER (path <> file AND NOT def AND NOT imp) AS calls, count(*) FILTER (path <> file AND NOT def AND NOT on_added) AS old_uses FROM j GROUP BY name, file)
    SELECT name, file, internal, external, defined, calls, external = 0 AS unused, defined = 1 AND calls > 0 AND old_uses = 0 AS closed FROM g
""")
def api_reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.lit("AIR").alias("file"))
    added = items(spark, sf_dir).where("l_linenumber <= 3").select(F.col("l_shipmode").alias("path"), F.col("l_linenumber").alias("line")).distinct()
    return A.index(names, refs(spark, sf_dir), added)


@ask("external_imports", """
    SELECT l_shipmode AS path, l_partkey AS name, count(*) AS refs FROM lineitem WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 5) WHERE s_suppkey = l_partkey AND l_shipmode = 'RAIL') GROUP BY 1, 2
""")
def external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are imports of the rail file, from packages named by nation; those of the first five are external."""
    imports = read(spark, sf_dir, "supplier").select(F.lit("RAIL").alias("path"), F.col("s_suppkey").alias("binding"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/x")).alias("module"))
    packages = read(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("package"))
    return A.without_external(refs(spark, sf_dir), imports, packages).groupBy("path", "name").agg(F.count(F.lit(1)).alias("refs"))


@ask("removed_fates", f"""
    WITH {REF_SQL}, removed AS (SELECT p_partkey AS name, p_brand AS file, p_partkey // 10 AS owner FROM part),
    l AS (SELECT name, count(*) FILTER (def) AS defs, count(*) FILTER (NOT def) AS uses FROM r WHERE path IN ('AIR', 'MAIL') GROUP BY name),
    o AS (SELECT name, count(*) AS n, bool_and(flag = 'N') AS proved FROM r WHERE path = 'SHIP' GROUP BY name),
    f AS (SELECT removed.*, coalesce(defs, 0) AS defs, coalesce(uses, 0) AS uses, CASE WHEN coalesce(n, 0) > 0 AND proved THEN 'dead' WHEN coalesce(defs, 0) > 1 THEN 'kept' WHEN coalesce(n, 0) = 0 AND coalesce(uses, 0) = 0 THEN 'dead' ELSE 'kept' END AS fate
          FROM removed LEFT JOIN l ON removed.name = l.name LEFT JOIN o ON removed.name = o.name),
    d AS (SELECT DISTINCT f.name, f.file FROM f JOIN part p ON p.p_partkey = f.name AND p.p_brand = f.file WHERE fate = 'dead' AND p_size > 10)
    SELECT f.name, f.file, owner, CASE WHEN d.name IS NOT NULL AND defs = 0 AND uses = 0 THEN 'dead' ELSE fate END AS fate FROM f LEFT JOIN d ON f.owner = d.name AND f.file = d.file
""")
def removed_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, r = read(spark, sf_dir, "part"), refs(spark, sf_dir)
    removed = part.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("file"), F.expr("p_partkey div 10").alias("owner"))
    types = part.where("p_size > 10").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("file"))
    return A.removed_dead(removed, r.where("path in ('AIR', 'MAIL')"), r.where("path = 'SHIP'").select("name", "path", (F.col("flag") == "N").alias("proved")), types)


@ask("member_liveness", """
    WITH m AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS name FROM lineitem), u AS (SELECT CASE WHEN l_discount >= 0.1 THEN NULL ELSE l_suppkey END AS receiver, l_partkey AS name, l_returnflag = 'R' AS test FROM lineitem WHERE l_returnflag <> 'A'),
    o AS (SELECT receiver, name, count(*) FILTER (NOT test) AS prod, count(*) FILTER (test) AS test FROM u WHERE receiver IS NOT NULL GROUP BY 1, 2), x AS (SELECT DISTINCT name FROM u WHERE receiver IS NULL)
    SELECT m.owner, m.name, coalesce(prod, 0) AS prod, coalesce(test, 0) AS test, CASE WHEN prod > 0 THEN 'live' WHEN x.name IS NOT NULL THEN 'ambiguous' WHEN test > 0 THEN 'test-only' ELSE 'dead' END AS status
    FROM m LEFT JOIN o ON m.owner = receiver AND m.name = o.name LEFT JOIN x ON m.name = x.name
""")
def member_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers own parts as members; sales at a high discount have no known receiver."""
    rows = items(spark, sf_dir)
    n = parts(rows)
    members = deal(rows.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name")), n, "name").distinct()
    uses = rows.where("l_returnflag <> 'A'").select(F.when(~(F.col("l_discount") >= 0.1), F.col("l_suppkey")).alias("receiver"), F.col("l_partkey").alias("name"), (F.col("l_returnflag") == "R").alias("is_test"))
    return A.member_liveness(members, uses, n)


@ask("declaration_lines", f"WITH {REF_SQL} SELECT p_partkey AS name, m.path, min(ln) AS line FROM part CROSS JOIN (SELECT DISTINCT l_shipmode AS path FROM lineitem WHERE l_shipmode IN ('AIR', 'MAIL')) m LEFT JOIN r ON r.name = p_partkey AND r.path = m.path GROUP BY 1, 2")
def declaration_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other file takes names as members of C, found by what follows the dot."""
    places = read(spark, sf_dir, "part").select(F.col("p_partkey"), F.explode(F.array(F.lit("AIR"), F.lit("MAIL"))).alias("path"))
    name = F.when(F.col("path") == "AIR", F.concat(F.lit("C."), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    found = A.declaration_lines(places.select("path", name.alias("name")), refs(spark, sf_dir).select("path", F.col("name").cast("string").alias("name"), "ln"))
    return found.select(F.regexp_replace("name", "^C\\.", "").cast("long").alias("name"), "path", "line")


@ask("competing_definitions", """
    WITH s AS (SELECT p_partkey AS symbol, p_brand AS source, CASE WHEN p_size > 25 THEN p_type END AS owner FROM part)
    SELECT l_partkey AS symbol, count(*) AS callers FROM lineitem JOIN s ON l_partkey = s.symbol
    WHERE NOT (s.owner IS NOT NULL AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = s.symbol AND 'Brand#' || s_nationkey <> s.source)) GROUP BY 1
""")
def competing_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers define the symbol of their number again, in a file named by nation."""
    symbols = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("source"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("owner"))
    callers = items(spark, sf_dir).select(F.col("l_partkey").alias("symbol")).join(symbols.select("symbol", "source"), "symbol")
    defined = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("path"))
    return A.without_competing(callers, symbols, defined).groupBy("symbol").agg(F.count(F.lit(1)).alias("callers"))


@ask("callers_with_same_file", """
    WITH a AS (SELECT DISTINCT o_orderkey AS path, 'N' AS symbol FROM orders WHERE o_orderstatus = 'O'),
    e AS (SELECT l_orderkey AS path, l_shipmode AS caller, l_returnflag AS callee, l_linenumber AS ln FROM lineitem)
    SELECT path, line, symbol, caller FROM (
        SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS symbol, l_shipinstruct AS caller FROM lineitem WHERE l_quantity > 49
        UNION SELECT e.path, CAST(ln AS BIGINT), callee, caller FROM e JOIN a ON e.path = a.path AND e.callee = a.symbol)
""")
def callers_with_same_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are files; in open ones the flag N is an affected symbol, and line items call flags from their ship mode."""
    rows = items(spark, sf_dir).withColumn("line", F.col("l_linenumber").cast("long"))
    callers = rows.where("l_quantity > 49").select(F.col("l_orderkey").alias("path"), "line", F.col("l_returnflag").alias("symbol"), F.col("l_shipinstruct").alias("caller"))
    edges = rows.select(F.col("l_orderkey").alias("path"), F.col("l_shipmode").alias("caller"), F.col("l_returnflag").alias("callee"), F.col("line").alias("ln"))
    affected = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("path"), F.lit("N").alias("symbol"))
    return A.with_same_file(callers, edges, affected)


@ask("visible_modules", """
    WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_size > 15 AND p_partkey > 1 UNION ALL SELECT s_suppkey, s_suppkey * 3 FROM supplier),
    v(module) AS (SELECT CAST(1 AS BIGINT) UNION SELECT dst FROM e JOIN v ON src = v.module)
    SELECT module FROM v
""")
def visible_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are modules below the part of half their number, public from a size on; suppliers re-export three times theirs."""
    modules = read(spark, sf_dir, "part").where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("module"), (F.col("p_size") > 15).alias("public"))
    reexports = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("module"), (F.col("s_suppkey") * 3).alias("target"))
    return A.visible_modules(modules, reexports, spark.createDataFrame([(1,)], "module long"))


@ask("descendants", """
    WITH RECURSIVE d(path, name) AS (SELECT p_brand, p_partkey FROM part WHERE p_partkey // 2 = 5 UNION SELECT p_brand, p_partkey FROM part JOIN d ON p_partkey // 2 = d.name AND p_brand = d.path)
    SELECT path, name FROM d
""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts inherit from that of half their number, if it has the same maker; the root is 5."""
    inherits = read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("name"), F.expr("p_partkey div 2").alias("base"))
    return Y.descendants(inherits, spark.createDataFrame([(5,)], "base long"))


@ask("trait_targets", """
    WITH RECURSIVE u AS (SELECT DISTINCT l_suppkey AS class, l_partkey AS trait FROM lineitem), d(class, trait) AS (SELECT * FROM u UNION SELECT d.class, u.trait FROM d JOIN u ON d.trait = u.class)
    SELECT class, count(*) AS targets FROM (SELECT DISTINCT class, p_type, d.trait FROM d JOIN part ON p_partkey = d.trait WHERE p_size > 40) GROUP BY class
""")
def trait_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = items(spark, sf_dir).select(F.col("l_suppkey").alias("class"), F.col("l_partkey").alias("trait")).distinct()
    methods = read(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("trait"), F.col("p_type").alias("method"))
    return A.trait_target_counts(uses, methods)


@ask("blamed_commits", """
    SELECT DISTINCT l_orderkey AS path, l_suppkey AS sha FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 2 AND 2 + o_custkey % 3
""")
def blamed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.lit(2).alias("lo"), (F.lit(2) + F.col("o_custkey") % 3).alias("hi"))
    blame = items(spark, sf_dir).select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") - 1).alias("ln"), F.col("l_suppkey").alias("sha"))
    return N.blamed(ranges, blame)


@ask("workspace_files", """
    WITH c AS (SELECT DISTINCT l_orderkey AS sha, l_shipmode || '/' || l_partkey AS path FROM lineitem), t AS (SELECT sha, count(*) AS total FROM c GROUP BY sha)
    SELECT c.sha, substr(path, 6) AS path, total FROM c JOIN t ON c.sha = t.sha WHERE path LIKE 'RAIL/%'
""")
def workspace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("sha"), F.concat_ws("/", "l_shipmode", F.col("l_partkey").cast("string")).alias("path")).distinct()
    return N.within_workspace(rows, "RAIL")


@ask("changed_files", "SELECT DISTINCT path FROM (SELECT p_type || '.py' AS path FROM part UNION ALL SELECT 'vendor/' || s_name FROM supplier UNION ALL SELECT 'src/' || n_name FROM nation) WHERE path NOT LIKE 'vendor/%'")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t, c: read(spark, sf_dir, t).select(c.alias("path"))
    return N.changed_files([named("part", F.concat("p_type", F.lit(".py"))), named("supplier", F.concat(F.lit("vendor/"), "s_name")), named("nation", F.concat(F.lit("src/"), "n_name"))])


@ask("asset_liveness", """
    WITH c AS (SELECT l_partkey AS key, count(*) FILTER (l_returnflag <> 'R') AS prod, count(*) FILTER (l_returnflag = 'R') AS test FROM lineitem GROUP BY 1),
    al AS (SELECT p_partkey AS key, p_partkey * 2 AS alias FROM part), k AS (SELECT key, prod, test FROM c UNION ALL SELECT al.key, prod, test FROM al JOIN c ON al.alias = c.key),
    t AS (SELECT key, CAST(sum(prod) AS BIGINT) AS prod, CAST(sum(test) AS BIGINT) AS test FROM k GROUP BY key), cand AS (SELECT p_partkey * 3 AS key FROM part)
    SELECT cand.key, coalesce(prod, 0) AS prod, coalesce(test, 0) AS test, CASE WHEN coalesce(prod, 0) > 0 OR n_nationkey IS NOT NULL THEN 'live' WHEN coalesce(test, 0) > 0 THEN 'test-only' ELSE 'dead' END AS status
    FROM cand LEFT JOIN t ON cand.key = t.key LEFT JOIN nation ON n_nationkey * 30 = cand.key
""")
def asset_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols are three times the parts' numbers, so most are no part; twice a number is its alias, nations name assets."""
    counts = L.reference_counts(items(spark, sf_dir).select(F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "R").alias("is_test")))
    part = read(spark, sf_dir, "part")
    both = L.with_aliases(counts, part.select(F.col("p_partkey").alias("key"), (F.col("p_partkey") * 2).alias("alias")))
    found = L.classify(part.select((F.col("p_partkey") * 3).alias("key")), both, read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 30).alias("key")))
    return found.select("key", "prod", "test", "status")


# What the lexer passes over in each family, and its names, as DuckDB writes them.
_C, _Q, _S = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", r'"(?:\\[\s\S]|[^"\\\n])*"?', r"''(?:\\[\s\S]|[^''\\\n])*''?"
_NAME = "[A-Za-z_][A-Za-z0-9_]*"
LEXED = {
    "zig": (rf"//[^\n]*|{_Q}|{_S}", _NAME),
    "java": (f"{_C}|{_Q}|{_S}", _NAME),
    "javascript": (rf"{_C}|{_Q}|{_S}|`(?:\\[\s\S]|[^`\\])*`?", "[A-Za-z_$][A-Za-z0-9_$]*"),
    "go": (f"{_C}|{_Q}|{_S}|`[^`]*`?", _NAME),
    "python": (rf'#[^\n]*|"{{3}}[\s\S]*?(?:"{{3}}|\z)|' + rf"''{{3}}[\s\S]*?(?:''{{3}}|\z)|{_Q}|{_S}", _NAME),
    "xojo": (r"//[^\n]*|''[^\n]*|\b[rR][eE][mM]\b[^\n]*|" + r'"(?:""|[^"\n])*"?', _NAME),
}
LEXED_NAMES = ["the", "ing", "und", "que", "BENCHMARK", "License"]
_LEXED_SQL = ",\n".join(
    f"k{i} AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{skip}', ' ', 'g'), '[0-9][A-Za-z0-9_]*|{name}')) AS name FROM documents WHERE text IS NOT NULL AND doc_id % {len(LEXED)} = {i})"
    for i, (skip, name) in enumerate(LEXED.values())
)


@ask("refs_lexed", f"""
    WITH {_LEXED_SQL},
    n AS (SELECT unnest({LEXED_NAMES}) AS wanted), k AS ({" UNION ALL ".join(f"SELECT *, {lang == 'xojo'} AS folded FROM k{i}" for i, lang in enumerate(LEXED))})
    SELECT doc_id AS path, wanted AS name, count(*) AS refs FROM k JOIN n ON CASE WHEN folded THEN lower(name) = lower(wanted) ELSE name = wanted END GROUP BY 1, 2
""")
def refs_lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References outside comments and strings; documents are read as the lexed languages, dealt by number."""
    langs = F.array(*map(F.lit, LEXED))
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.element_at(langs, (F.col("doc_id") % len(LEXED) + 1).cast("int")).alias("lang"), "text")
    names = spark.createDataFrame([(n,) for n in LEXED_NAMES], "name string")
    return X.references(files, names).groupBy(F.col("path").cast("long").alias("path"), F.col("symbol").alias("name")).agg(F.count(F.lit(1)).alias("refs"))


@ask("line_offsets", r"""
    WITH p AS (SELECT doc_id AS key, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))),
    r AS (SELECT key, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ln, unnest(l) AS line, len(l) AS n FROM p), k AS (SELECT * FROM r WHERE n = 1 OR ln < n - 1 OR line <> '')
    SELECT key, ln, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY key ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k
""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.references import lines

    docs = read(spark, sf_dir, "documents").where("text is not null and not contains(text, '\r')")
    return X.offset(lines(docs, "doc_id", "text")).select("key", "ln", "start")


@ask("sequence_diagrams", r"""
    WITH e AS (SELECT * FROM (SELECT conv_id AS path, turn AS ln, role AS caller, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS callee FROM conversations) WHERE callee IS NOT NULL),
    s AS (SELECT path, ln, 0 AS side, caller AS name FROM e UNION ALL SELECT path, ln, 1, callee FROM e), f AS (SELECT path, name, min((ln, side)) AS spot FROM s GROUP BY path, name),
    p AS (SELECT path, string_agg(name, ',' ORDER BY spot) AS participants, string_agg('participant ' || name, chr(10) ORDER BY spot) AS head FROM f GROUP BY path),
    c AS (SELECT path, string_agg(caller || '->>' || callee || ': ' || callee || '()', chr(10) ORDER BY ln) AS body FROM e GROUP BY path)
    SELECT p.path, participants, 'sequenceDiagram' || chr(10) || head || chr(10) || body AS diagram FROM p JOIN c ON p.path = c.path
""")
def sequence_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.usage import call_edges

    edges = call_edges(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select(F.col("conv_id").alias("path"), "caller", "callee", F.col("seq").alias("ln"), F.lit(0).alias("col"))
    return X.diagram(edges).select("path", F.array_join("participants", ",").alias("participants"), "diagram")


@ask("node_at_point", """
    WITH n AS (SELECT DISTINCT l_orderkey AS path, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS sl, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(l_quantity AS BIGINT) AS el FROM lineitem),
    p AS (SELECT o_orderkey AS path, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 40 AS ln FROM orders)
    SELECT p.path, ln, arg_max(sl * 100 + el - sl, (sl - el, sl)) AS id FROM p JOIN n ON p.path = n.path AND (sl < ln OR sl = ln) AND (el > ln OR el = ln) GROUP BY p.path, ln
""")
def node_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments are nodes of days, shorter ones deeper; the point is 40 days after the order."""
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)
    n = items(spark, sf_dir).select(F.col("l_orderkey").alias("path"), day("l_shipdate").alias("sl"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("el")).distinct()
    nodes = n.select("path", (F.col("sl") * 100 + F.col("el") - F.col("sl")).alias("id"), (F.col("sl") - F.col("el")).alias("depth"), F.lit("k").alias("kind"), F.lit("n").alias("name"), "sl", F.lit(0).alias("sc"), "el", F.lit(9).alias("ec"))
    points = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (day("o_orderdate") + 40).alias("ln"), F.lit(1).alias("col"))
    return Y.at_point(nodes, points).select("path", "ln", "id")
