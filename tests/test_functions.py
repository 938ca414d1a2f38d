import json

from hypothesis import given
from hypothesis import strategies as st

from codestrata.functions import paths as P
from codestrata.functions import toon
from codestrata.sources import diffs, files, git
from codestrata.streaming import requests
from pyspark.sql import functions as F


def values(spark, items, expr):
    return [r[0] for r in spark.createDataFrame([(i,) for i in items], "x string").select(expr(F.col("x"))).collect()]


def test_paths(spark):
    assert values(spark, ["a/b.rs", "x.TSX", "y", "a.b/c", "m.h"], P.language) == ["rust", "tsx", None, None, "c"]
    tests = ["a/b_test.go", "src/app.spec.ts", "test_x.py", "FooTest.java", "footest.java", "tests/x.rs", "contest.py", "conftest.py"]
    assert values(spark, tests, P.is_test_path) == [True, True, True, True, False, True, False, True]
    assert values(spark, ["a/vendor/x.c", "vendor/x.c", "dist", "q.min.js", "Cargo.lock"], lambda c: P.matches_glob(c, P.COCHANGE_EXCLUDES)) == [True, True, False, True, True]
    lines = ["import x", "from a import b", "use a::b;", "using var f = g();", "using System;", "important = 1", "export { a }", None]
    assert values(spark, lines, P.is_import_line) == [True, True, True, False, True, False, True, False]
    head = spark.createDataFrame([("run", "#!/usr/bin/env python\n"), ("a.py", "# @generated"), ("a.py", "x"), ("b.txt", "#!/bin/sh"), ("_ide_helper.php", "")], "p string, h string")
    assert [r[0] for r in head.select(P.keep_candidate(F.col("p"), F.col("h"))).collect()] == [True, False, True, False, False]
    rules = P.last_rule(spark.createDataFrame([("a/x.gen",), ("keep.gen",), ("b",)], "path string"), [("*.gen", True), ("keep.gen", False)])
    assert {tuple(r) for r in rules.collect()} == {("a/x.gen", True), ("keep.gen", False), ("b", False)}
    pairs = P.lock_pairs(spark, spark.createDataFrame([("w/go.mod",), ("w/go.sum",), ("v/go.sum",)], "path string"))
    assert [tuple(r) for r in pairs.collect()] == [("w/go.mod", "w/go.sum")]


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@ def f
 a
--- a/looks like a header
+b
+c
 d
\\ No newline at end of file
--- "a/sp\\303\\251.py"
+++ /dev/null
@@ -1 +0,0 @@
-gone
"""


def test_diff(spark):
    lines = diffs.parse(spark.createDataFrame([("d", DIFF), ("n", None), ("e", "")], "diff_id string, text string"))
    assert {(r["path"], r["line"]) for r in diffs.added_lines(lines).collect()} == {("x.py", 1), ("x.py", 2)}
    assert {tuple(r)[1:] for r in diffs.hunks(lines).collect()} == {("x.py", 1, 1, 3, 1, 4, 2), ("/dev/null", 1, 1, 1, 0, 0, 0)}
    assert {r["path"] for r in diffs.changed_paths(lines).collect()} == {"x.py", "spé.py"}
    assert {(r["path"], r["line"]) for r in diffs.deleted_at(lines).collect()} == {("x.py", 1), ("/dev/null", 0)}


def test_signature_changes(spark):
    text = "--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,2 @@\n-def go(a):\n+def go(a, b):\n-def stay(a):\n+def stay(a):\n"
    lines = diffs.parse(spark.createDataFrame([("d", text)], "diff_id string, text string"))
    got = diffs.signature_changes(lines, spark.createDataFrame([("go",), ("stay",), ("none",)], "name string")).collect()
    assert [(r["name"], r["old_line"], r["new_line"]) for r in got] == [("go", "def go(a):", "def go(a, b):")]


def test_git(spark, tmp_path):
    run = lambda *a: git.git(str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x\ny\n")
    (tmp_path / "b.py").write_text("z\n")
    run("add", "."), run("commit", "-qm", "two")
    (tmp_path / "a.py").write_text("x\nq\n")
    commits, changed = git.commits(spark, str(tmp_path))
    assert [(r["ord"], r["author_mail"], r["is_merge"]) for r in commits.orderBy("ord").collect()] == [(0, "e@x", False), (1, "e@x", False)]
    assert sorted(r["path"] for r in changed.collect()) == ["a.py", "a.py", "b.py"]
    assert git.blame(spark, str(tmp_path), ["a.py"]).count() == 2
    assert diffs.added_lines(diffs.parse(git.diff(spark, str(tmp_path)))).count() == 1
    try:
        git.checked("--output=x")
        raise AssertionError
    except ValueError:
        pass


def test_tree(spark, tmp_path):
    for name, text in {"a.py": "x", "sub/b.rs": "y", "sub/.hid.py": "z", "vendor/c.py": "v", "g.py": "# @generated", "n.txt": "t", "run": "#!/bin/bash\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    got = {(r["path"], r["lang"]) for r in files.read_tree(spark, str(tmp_path), excluded_dirs=["vendor"]).collect()}
    assert got == {("a.py", "python"), ("sub/b.rs", "rust"), ("run", "bash")}
    assert [r["name"] for r in files.names(spark, many="a, ,b").orderBy("ord").collect()] == ["a", "b"]


def test_toon():
    v = {"a": 1, "s": "x,y", "n": None, "l": [1, 2.5], "t": [{"k": "1", "v": True}, {"k": "b", "v": False}], "o": {"x": 1.0}, "m": [{"k": 1}, 2]}
    assert toon.encode(v) == 'a: 1\ns: "x,y"\nn: null\nl[2]: 1,2.5\nt[2]{k,v}:\n  "1",true\n  b,false\no:\n  x: 1\nm[2]:\n  - k: 1\n  - 2'
    assert toon.encode({}) == "" and toon.auto({})[0] == "json" and toon.encode([]) == "[0]:"
    assert toon.auto([{"name": "abc", "value": i} for i in range(9)])[0] == "toon"
    rows = [{"aaa": 1, "b": 2}, {"aaa": 3}, {"aaa": 3, "b": 1}]
    assert toon.fill_missing(rows)[1] == {"aaa": 3, "b": None} and toon.fill_missing(rows[:1]) == rows[:1]


@given(st.text(max_size=20))
def test_toon_strings_read_back(s):
    out = toon.text(s)
    assert (json.loads(out) if out[:1] == '"' else out) == s


def test_requests(spark, tmp_path):
    lines = ['{"id":"1","command":"refs","name":"f"}', "", "nope", '{"id":"2","command":"refs"}', '{"id":"3","command":"zap"}', "[1]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    out = []
    handler = lambda rows: rows.select("id", F.concat(F.lit("found "), F.col("request.name")).alias("answer"))
    q = requests.serve(spark.readStream.text(str(tmp_path / "in")), {"refs": handler}, lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["id"] or "", r["answer"], r["error"]) for r in out if r["answer"]) == [("1", "found f", None)]
    assert sorted(r["error"] for r in out if r["error"]) == ["invalid_json", "invalid_json", "missing_field", "unknown_command"]


def test_conventions(spark):
    from codestrata.functions import conventions as C

    rows = [("FooTest", "class", "php"), ("Foo.testBar", "method", "php"), ("Foo.testing", "method", "php"), ("Foo.setUp", "method", "php"), ("FooTest", "class", "java")]
    df = spark.createDataFrame(rows, "n string, k string, l string")
    assert [r[0] for r in df.select(C.is_phpunit(F.col("n"), F.col("k"), F.col("l"))).collect()] == [True, True, False, True, False]
    rows = [("fix", "function", "a/conftest.py", None, None), ("test_a", "function", "test_m.py", None, None), ("test_a", "function", "m.py", None, None), ("T.test_a", "method", "m.py", None, True), ("T.help", "method", "m.py", None, True), ("T", "class", "m.py", None, True)]
    df = spark.createDataFrame(rows, "n string, k string, p string, c string, u boolean")
    assert [r[0] for r in df.select(C.is_python_test(F.col("n"), F.col("k"), F.lit("python"), F.col("p"), F.col("c"), F.col("u"))).collect()] == [True, True, False, True, False, True]
    assert values(spark, ["x/app/Jobs/a.php", "app/Jobs/a.php", "src/a.php"], lambda c: C.by_framework(c, "laravel")) == [True, True, False]
    assert values(spark, ['{"dependencies":{"next":"1"}}', '{"devDependencies":{"x":"1"}}', "nope", None], C.framework) == ["nextjs", None, None, None]
    xml = """<a.b.View android:name=".Main$Inner" xandroid:name="no" class = 'p.q.Cls' other="z"/><plain/>"""
    got = {r["name"] for r in C.xml_references(spark.createDataFrame([("f", xml), ("g", None)], "path string, text string")).collect()}
    assert got == {"View", "Main", "Inner", "Cls"}
    files_ = spark.createDataFrame([("a", "x"), ("b", "y\n" * 6000), ("c", "z")], "path string, text string")
    taken, left = C.untracked(files_, spark.createDataFrame([("a",)], "path string"))
    assert [r["path"] for r in taken.collect()] == ["c"] and [r["path"] for r in left.collect()] == ["b"]
    lines = ["A=1 env tool --config f refs x", "echo 'tool refs'; ls", "time -o out /bin/tool symbols | head", "tool nope", None, "ls && tool calls"]
    out = C.subcommand(spark.createDataFrame([(x,) for x in lines], "command string"), "tool", ["refs", "symbols", "calls"])
    assert [r["subcommand"] for r in out.collect()] == ["refs", None, "symbols", None, None, "calls"]
