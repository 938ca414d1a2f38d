from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from codestrata.config import CoChangeConfig
from codestrata.operators import cochange, graph, intervals, liveness, references, snapshots, symbols, usage


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*(cols or df.columns)).collect()}


@pytest.fixture(scope="module")
def history(spark):
    rows = [(f"c{i}", p) for i in range(3) for p in ("a", "b")] + [("c3", "a"), ("c4", "c")]
    files = table(spark, rows, "sha string, path string")
    evidence = table(spark, [("a", f"c{i}", f"m{i}", 1000 * i) for i in range(4)], "source string, sha string, author_mail string, author_time long")
    return evidence, files


def test_cochange_pair_and_smoothing(history):
    evidence, files = history
    config = CoChangeConfig(author_window_days=0)
    (row,) = cochange.ranked(cochange.candidates(evidence, files, config), config).collect()
    assert (row["source"], row["candidate"], row["co"], row["den"]) == ("a", "b", 3, 4)
    assert row["confidence"] == 0.75 and row["score"] == pytest.approx((3 + 1) / (4 + 9))
    raw = replace(config, smoothing=False)
    assert cochange.candidates(evidence, files, raw).first()["score"] == 0.75


def test_cochange_author_window_and_caps(spark, history):
    evidence, files = history
    one = evidence.withColumn("author_mail", F.lit("m"))
    assert cochange.candidates(one, files, CoChangeConfig()).first()["score"] == pytest.approx((1 + 1) / (1 + 9))  # one unit
    assert cochange.candidates(evidence, files, CoChangeConfig(max_files_per_commit=1)).count() == 0
    none = cochange.diagnostics(cochange.candidates(evidence, files, CoChangeConfig()), CoChangeConfig(min_confidence=0.9)).first()
    assert (none["failed_confidence"], none["returned"]) == (1, 0)


def test_evidence_choice_and_missing(spark):
    blame = table(spark, [("a", "1"), ("b", "1"), ("b", "2")], "source string, sha string")
    past = table(spark, [("a", "1"), ("a", "3"), ("c", "9")], "source string, sha string")
    assert as_set(cochange.choose_evidence(blame, past, 2), "source", "mode", "sha") == {("a", "history", "1"), ("a", "history", "3"), ("b", "blame", "1"), ("b", "blame", "2"), ("c", "history", "9")}
    pairs = table(spark, [("x", "y", 0.5), ("z", "y", 0.6), ("x", "z", 0.9), ("p", "q", 0.9)], "source string, candidate string, confidence double")
    changed = table(spark, [("x",), ("z",)], "path string")
    assert as_set(cochange.missing(pairs, changed)) == {("y", "z", 0.6)}


def test_liveness(spark):
    c = table(spark, [("f", "f"), ("g", "g"), ("h", "h"), ("i", "i"), ("i", "i"), ("k", "k")], "name string, key string")
    refs = table(spark, [("f", False), ("g", True), ("i", False)], "key string, is_test boolean")
    assets = table(spark, [("k",)], "key string")
    got = {(r["key"], r["status"]) for r in liveness.classify(c, liveness.reference_counts(refs), assets).collect()}
    assert got == {("f", "live"), ("g", "test-only"), ("h", "dead"), ("i", "duplicate"), ("k", "live")}
    dead = table(spark, [("a", 1), ("a", 2), ("b", None)], "file string, line int")
    assert as_set(liveness.touched(dead, table(spark, [("a", 2), ("a", 2)], "file string, line int"))) == {("a", 2), ("b", None)}


def test_moves_pair_in_order(spark):
    r = table(spark, [("s", 1), ("s", 2), ("s", 3), (None, 4)], "sig string, ord int")
    a = table(spark, [("s", 7), ("s", 8), (None, 9), ("t", 9)], "sig string, ord int")
    moved, left, new = snapshots.moves(r, a, ["sig"], ["ord"])
    assert as_set(moved) == {("s", 1, 7), ("s", 2, 8), (None, 4, 9)}
    assert as_set(left) == {("s", 3)} and as_set(new) == {("t", 9)}


def test_mutual_unique(spark):
    schema = "id int, lang string, size int, exports string"
    d = table(spark, [(1, "p", 10, "e"), (2, "p", 10, "f"), (3, "p", 12, "f"), (4, "p", 10, "g"), (6, "p", 100, "h"), (8, "p", 10, "h")], schema)
    u = table(spark, [(11, "p", 20, "e"), (12, "p", 10, "f"), (14, "q", 10, "g"), (15, "p", 9, "h")], schema)
    assert as_set(snapshots.mutual_unique(d, u)) == {(1, 11), (8, 15)}


def test_innermost_and_hunks(spark):
    outer = table(spark, [("p", "A", 0, 20), ("p", "B", 2, 9), ("q", "C", 0, 9)], "path string, id string, lo int, hi int")
    inner = table(spark, [("p", "f", 3, 4), ("p", "B", 2, 9), ("q", "g", 5, 11)], "path string, id string, lo int, hi int")
    assert as_set(intervals.innermost(inner, outer), "id", "container") == {("f", "B"), ("B", "A"), ("g", None)}
    s = table(spark, [("p", "f", 0, 4), ("p", "g", 10, 12)], "path string, id string, sl int, el int")
    h = table(spark, [("p", 1, 2, 3, 0, 0), ("p", 2, 0, 11, 5, 5)], "path string, hunk int, old_count int, new_start int, new_count int, added_in_hunk int")
    assert as_set(intervals.affected(s, h), "id", "change") == {("f", "removed"), ("g", "added")}
    lines = table(spark, [("d", i, f"t{i}") for i in range(12)], "key string, ln int, text string")
    text = intervals.snippet(lines, table(spark, [("d", 9)], "key string, at int"), 1).first()["snippet"]
    assert text == "   9 | t8\n> 10 | t9\n  11 | t10"


def test_references(spark):
    files = table(spark, [("a", "foo bar\r\nfoobar foo foo\n", "python"), ("b", None, "python"), ("c", "", "go")], "key string, text string, lang string")
    assert as_set(references.search(files, "key", "text", ["foo"])) == {("a", 0, "foo", 1), ("a", 1, "foo", 2)}
    rules = table(spark, [("R", "python", "error", "oba")], "id string, language string, severity string, pattern string")
    assert as_set(references.lint(files, "key", "text", "lang", rules), "rule_id", "ln", "name") == {("R", 1, "foobar")}


def test_graph(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = table(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert (1, 1, 3) in as_set(graph.closure(e)) and (1, 4, 3) in as_set(graph.closure(e)) and graph.closure(e).count() == 12
    assert as_set(graph.closure(e, table(spark, [(3,)], "node int"))) == {(3, 1, 1), (3, 4, 1), (3, 2, 2), (3, 3, 3)}
    named = table(spark, [("m", "f", "lib", "g")], "module string, name string, to string, as string")
    wild = table(spark, [("lib", "top")], "module string, to string")
    assert as_set(graph.live(named, wild, table(spark, [("m", "f"), ("m", "h")], "module string, name string"))) == {("m", "f"), ("m", "h"), ("lib", "g"), ("top", "g")}


def test_usage(spark):
    t = table(spark, [("A=1 B=2 /usr/bin/git log | head",), ("ls && rm x",), ("",), (None,)], "command string")
    assert [r[0] for r in t.select(usage.shell_category()).collect()] == ["git", "ls", "(empty)", None]
    turns = table(spark, [(1, 0, "assistant", "x"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "")], "s int, t int, role string, text string")
    assert as_set(usage.interactions(turns, "s", "t", "role", "text"), "interaction", "replies", "prompt") == {(1, 1, "hi")}


SOURCE = '''"""Doc."""
import os
from a.b import c

LIMIT = 3


class Box:
    """A box."""

    def open(self, key):
        if key and LIMIT:
            return os.path.join(key)
        return [k for k in key]

    def _shut(self):
        pass


def main():
    def inner():
        return Box().open(1)
    return inner()
'''


def test_symbols(spark):
    files = table(spark, [("m.py", "python", SOURCE), ("bad.py", "python", "def ("), ("x.go", "go", "func Run(a int) {\n  go()\n}\n"), ("n", None, "x"), ("e.py", "python", None)], "path string, lang string, text string")
    got = {(r["path"], r["name"]): r for r in symbols.extract(files).collect()}
    assert set(got) == {("m.py", n) for n in ("LIMIT", "Box", "open", "_shut", "main", "inner")} | {("x.go", "Run")}
    box, op = got["m.py", "Box"], got["m.py", "open"]
    assert (box["kind"], box["doc"], op["kind"], op["container"], op["complexity"]) == ("class", "A box.", "method", "Box", 4)
    assert got["m.py", "_shut"]["exported"] is False and got["m.py", "inner"]["exported"] is False
    assert (got["x.go", "Run"]["el"], got["x.go", "Run"]["exact"]) == (2, False)
    assert {("open", "join"), ("inner", "open"), ("inner", "Box"), ("main", "inner")} <= as_set(symbols.calls(files), "caller", "callee")
    assert as_set(symbols.imports(files), "src", "ln", "kind") == {("os", 1, "import"), ("a.b", 2, "import")}


def test_signatures(spark):
    from codestrata.operators import signatures as S

    sigs = ["fn f(a: Map<K, V>, b: [u8; 2]) -> X", "f()", "f( )", "const x", "f(a => g(a, 1), b)", None]
    got = [r[0] for r in table(spark, [(s,) for s in sigs], "s string").select(S.parameters(F.col("s"))).collect()]
    assert [g if g is None else len(g) for g in got] == [2, 0, 0, None, 2, None]
    rows = [
        ("function", "typescript", "f(a: X)", "f(a: X, b?: Y, c = 1)", None, "compatible"),
        ("function", "typescript", "f(a: X)", "f(a: X, b: Y)", None, "modified"),
        ("function", "typescript", "f(a: X)", "f(a: X, ...r: Y[])", True, "closed"),
        ("function", "python", "def f(a):", "def f(a, *, b=1):", None, "compatible"),
        ("function", "python", "def f(a):", "def f(a, *):", None, "modified"),
        ("function", "python", "def f(a, **k):", "def f(a, **k, b=1):", None, "modified"),
        ("function", "python", "def f():", "def f(b=1):", None, "compatible"),
        ("constant", "rust", "pub const N: usize = 1;", "pub const N: usize = 2;", None, "value"),
        ("constant", "rust", "pub static mut N: usize = 1;", "pub static mut N: usize = 2;", None, "modified"),
        ("variable", "typescript", "export const A = 1", "export const A = 2", None, "value"),
        ("variable", "typescript", "export const A = {a: 1}", "export const A = {a: 2}", None, "modified"),
        ("variable", "typescript", "export let A = 1", "export let A = 2", None, "modified"),
    ]
    df = table(spark, rows, "k string, l string, o string, n string, c boolean, want string")
    for r in df.withColumn("got", S.classify(F.col("k"), F.col("l"), F.col("o"), F.col("n"), F.col("c"))).collect():
        assert r["got"] == r["want"], r
    assert [r[0] for r in df.limit(2).select(S.same_arity(F.col("o"), F.col("n"))).collect()] == [False, False]


def test_impact(spark):
    from codestrata.operators import impact as I

    refs = table(spark, [("b.ts", "typescript", "f", 3, "g", False), ("a.ts", "typescript", "f", 9, "h", False), ("c.py", "python", "f", 1, "x", False), ("d.ts", "tsx", "m", 2, "y", False), ("e.ts", "tsx", "m", 4, "z", False), ("t.ts", "tsx", "f", 1, "t", True)], "ref_path string, ref_lang string, name string, line int, caller string, is_test boolean")
    symbols = table(spark, [("src/a.ts", "typescript", "f", None, "modified"), ("src/a.ts", "typescript", "C.m", "C", "removed")], "path string, lang string, symbol string, owner string, change string")
    owners = table(spark, [("d.ts", "C")], "ref_path string, name string")
    got = as_set(I.candidates(refs, symbols, owners), "ref_path", "symbol")
    assert got == {("b.ts", "f"), ("a.ts", "f"), ("d.ts", "C.m")}
    schema = "id int, is_import boolean, change string, function_value boolean, same_arity boolean, reexport_move boolean, confidence string, name string, ref_lang string, owner string, direct_import boolean, local_shadow boolean, macro_callee boolean, in_macro boolean, has_evidence boolean"
    none = [None] * 5
    rows = [
        (1, True, "modified", None, None, None, "exact", "f", "tsx", None, *none),
        (2, True, "removed", None, None, None, "exact", "f", "tsx", None, False, None, None, None, None),
        (3, False, "modified", True, True, None, "exact", "f", "rust", None, *none),
        (4, False, "modified", True, False, None, "bare", "get", "go", None, *none),
        (5, False, "modified", None, None, None, "exact", "f", "tsx", None, False, None, None, None, None),
        (6, False, "modified", None, None, None, "exact", "f", "rust", None, None, None, None, False, False),
        (7, False, "modified", None, None, None, "exact", "f", "rust", None, *none),
        (8, False, "modified", None, None, None, "exact", "f", "rust", "T", None, None, True, None, None),
    ]
    routes = {r["id"]: r["r"] for r in table(spark, rows, schema).select("id", I.route(["get"]).alias("r")).collect()}
    assert routes == {1: "informational", 2: "normal", 3: "informational", 4: "low", 5: "low", 6: "low", 7: "normal", 8: "normal"}
    routed = table(spark, [("p", 1, "f", "c", "low"), ("p", 1, "f", "c", "normal"), ("p", 1, "a", "c", "normal"), ("q", 2, "f", "d", "informational")], "path string, line int, symbol string, caller string, route string")
    settled = I.settle(routed)
    assert {(r["path"], r["route"], tuple(r["symbols"])) for r in settled.collect()} == {("p", "normal", ("a", "f")), ("q", "informational", ("f",))}
    assert [tuple(r["symbols"]) for r in I.unresolved(settled, table(spark, [("q",)], "path string")).collect()] == [("a", "f")]
    removed = table(spark, [("a.rs", "f", "fn f()"), ("a.rs", "g", "fn g()")], "path string, name string, header string")
    added = table(spark, [("b.rs", "f", "fn f()"), ("b.rs", "g", "fn g(x)")], "path string, name string, header string")
    uses = table(spark, [("a.rs", "f", "b.rs"), ("a.rs", "g", "b.rs")], "path string, name string, target string")
    assert as_set(I.covered_moves(removed, uses, added)) == {("a.rs", "f", "b.rs")}
    kept = table(spark, [("function", "go", True, None, None, None, "modified", True, None, None, None, True), ("function", "go", True, None, None, None, "modified", False, None, None, None, True), ("class", "java", True, None, None, None, "modified", None, True, None, None, True), ("class", "java", False, None, None, None, "modified", None, True, None, None, True)], "kind string, lang string, exported boolean, is_test boolean, is_override boolean, is_local boolean, change string, signature_changed boolean, header_added boolean, deleted_inside boolean, object_literal boolean, named_in_change boolean")
    assert I.crosses_files(kept).count() == 2


def test_walks_do_not_gather_partitions(spark):
    chain = spark.range(12).selectExpr("id as src", "id + 1 as dst").repartition(3)
    got = graph.closure(chain, table(spark, [(0,)], "node long"))
    assert got.count() == 12 and got.rdd.getNumPartitions() <= 3 and graph.more(chain, chain.repartition(5)).rdd.getNumPartitions() == 5
