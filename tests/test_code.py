"""Lexing, syntax, templates, inputs, outputs, interface changes and the review, on small trees with answers worked out by hand."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata.functions import toon
from codestrata.operators import api as A
from codestrata.operators import lexing as X
from codestrata.operators import review as V
from codestrata.operators import syntax as Y
from codestrata.sources import files as FL
from codestrata.sources import git as G
from codestrata.sources import inputs as I
from codestrata.sources import sinks as K
from codestrata.sources import templates as T

FILES = "path string, lang string, text string"


def found(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_lexer_skips_comments_and_strings(spark):
    files = spark.createDataFrame([
        ("a.py", "python", "def foo():\n    '''foo'''\n    # foo\n    return bar(foo, 'foo')\n"),
        ("b.ts", "typescript", "// foo\nconst x = `foo`;\nfoo(1);\nclass foo {}\n"),
        ("c.rs", "rust", "fn foo<'a>(x: &'a str) -> char { 'f' }\n/* foo\nfoo */\nlet y = r#\"foo\"#; bar.foo();\n"),
        ("d.xojo_code", "xojo", "Sub FOO()\n ' foo\n Rem foo\n x = \"say \"\"foo\"\" \" + foo\n"),
        ("e.go", "go", "func (s *Srv) foo(w W) {\n  s.foo(w)\n}\n"),
        ("f.txt", None, "foo"), ("g.py", "python", None), ("h.py", "python", ""),
    ], FILES)
    t = X.tokens(files).where("lower(name) = 'foo'")
    assert found(t, "path", "ln", "col", "context") == {
        ("a.py", 0, 4, "definition"), ("a.py", 3, 15, "reference"), ("b.ts", 2, 0, "reference"), ("b.ts", 3, 6, "definition"), ("c.rs", 0, 3, "definition"), ("c.rs", 3, 22, "reference"),
        ("d.xojo_code", 0, 4, "definition"), ("d.xojo_code", 3, 22, "reference"), ("e.go", 0, 14, "definition"), ("e.go", 1, 4, "reference"),
    }
    assert {r["role"] for r in t.where("path = 'b.ts' and ln = 2").collect()} == {"callee"}
    refs = X.references(files, spark.createDataFrame([("foo",), ("nothing",)], "name string"))
    assert refs.where("path = 'd.xojo_code'").count() == 2  # compared in any case
    first = X.ordered(refs).first()
    assert (first["context"], first["path"]) == ("definition", "a.py")
    got = X.batch(files, spark.createDataFrame([(0, "nothing"), (1, "foo")], "ord int, name string")).collect()
    assert [(r["name"], len(r["references"])) for r in got] == [("nothing", 0), ("foo", 10)]
    assert X.masked("a = 'x' # y", "python") == "a =        "


def test_lexer_synthetic_sources_and_confidence(spark):
    files = spark.createDataFrame([
        ("a.sh", "bash", "cleanup() { :; }\ntrap 'cleanup' EXIT\n"),
        ("b.php", "php", "<?php\nclass B {\n function run(Repo $r) { $this->save(); $r->save(); $q->save(); Repo::save(); call_user_func('save'); }\n}\n"),
        ("c.rs", "rust", "#[serde(with = \"codec\")]\nstruct S { a: u8 }\nlet t = (alpha, beta);\n"),
        ("d.cpp", "cpp", "class Fwd;\nint sum(int a) { return sum(a); }\nSUM(2);\n"),
    ], FILES)
    t = X.tokens(files)
    assert found(t.where("path = 'a.sh' and name = 'cleanup'"), "ln", "context") == {(0, "definition"), (1, "reference")}
    saves = t.where("path = 'b.php' and name = 'save'").orderBy("col").collect()
    assert [r["confidence"] for r in saves] == ["inferred", "inferred", "bare", "exact", "exact"] and saves[-1]["role"] == "string"
    assert t.where("name = 'codec'").count() == 1
    assert found(t.where("name in ('alpha', 'beta')"), "role") == {"value"}
    assert t.where("name = 'Fwd'").count() == 0  # a forward declaration defines nothing
    assert found(t.where("name = 'sum'"), "ln", "context") == {(1, "definition"), (1, "reference")}
    assert found(X.definitions(t).where("path = 'd.cpp'"), "name") == {"sum"}


def test_lexed_calls_imports_and_surfaces(spark):
    files = spark.createDataFrame([
        ("a.go", "go", "func a() {\n b()\n}\nfunc c() { a() }\n"),
        ("b.ts", "typescript", "import { x } from './x';\nexport { x as y, z };\n"),
        ("c.rs", "rust", "pub use crate::a::{One, Two as Three};\n"),
        ("d.c", "c", "enum color { RED, GREEN = 2 };\ntypedef struct node { int a; } node_t;\n"),
    ], FILES)
    t = X.tokens(files)
    assert found(X.enclosing(t.where("path = 'a.go'")), "caller", "callee") == {("a", "b"), ("c", "a")}
    assert (("b.ts", 0) in found(X.import_lines(t), "path", "ln"))
    assert found(X.surface(files), "path", "name") == {("b.ts", "y"), ("b.ts", "z"), ("c.rs", "One"), ("c.rs", "Three")}
    assert found(X.cpp_aliases(files), "symbol", "alias") == {("color", "RED"), ("color", "GREEN"), ("node", "node_t")}
    row = spark.range(1).select(X.go_receiver(F.lit("func (s *Srv) foo()")).alias("g"), X.overrides(F.lit("@Override public"), F.lit("java")).alias("o"), X.overrides(F.lit("x"), F.lit("go")).alias("n"))
    assert tuple(row.first()) == ("Srv", True, False)


def test_text_helpers(spark):
    row = spark.range(1).select(X.shortened(F.lit("abcdef"), 3), X.shortened(F.lit("abc"), 3), X.dedented(F.lit("  a\n\n    b")), X.resolved(F.lit("a/./b/../c")), X.resolved(F.lit("../x"))).first()
    assert tuple(row) == ("abc...", "abc", "a\n\n  b", "a/c", None)
    lines = spark.createDataFrame([("k", 0, "é1"), ("k", 1, ""), ("k", 2, "xyz")], "key string, ln int, line string")
    starts = X.offset(lines)
    assert found(starts, "ln", "start") == {(0, 0), (1, 4), (2, 5)}
    assert found(X.place(starts, spark.createDataFrame([("k", 6), ("k", 4)], "key string, offset long")), "offset", "ln", "col") == {(6, 2, 1), (4, 1, 0)}
    edges = spark.createDataFrame([("f", "a", "b<c>", 2, 0), ("f", "m", "a", 1, 0)], "path string, caller string, callee string, ln int, col int")
    d = X.diagram(edges).first()
    assert d["participants"] == ["m", "a", "b<c>"] and d["diagram"] == "sequenceDiagram\nparticipant m\nparticipant a\nparticipant b_c_\nm->>a: a()\na->>b_c_: b_c_()"


CODE = """import unittest


class Base(unittest.TestCase):
    pass


class Mine(Base):
    def test_a(self):
        for i in range(3):
            if i:
                self.go(i)

        def inner():
            return 1 if True else 2

X = 1
"""


def test_syntax(spark):
    n = Y.nodes(spark.createDataFrame([("a.py", "python", CODE), ("bad.py", "python", "def ("), ("x.rs", "rust", "fn a() {}")], FILES)).cache()
    points = spark.createDataFrame([("a.py", 11, 21)], "path string, ln int, col int")
    assert Y.at_point(n, points).first()["name"] == "go"
    inside = Y.in_range(n, spark.createDataFrame([("a.py", 9, 11), ("a.py", 1, 1)], "path string, lo int, hi int"))
    assert found(inside, "lo", "kind") == {(9, "For"), (1, "Module")}
    assert found(Y.outline(n), "name") == {None, "Base", "Mine"} and found(Y.diagnostics(n), "path", "ln") == {("bad.py", 0)}
    assert found(Y.query(n, "FunctionDef", "^test_", "ClassDef"), "name") == {"test_a"}
    with pytest.raises(ValueError):
        Y.query(n, "FunctionDef) or true")
    assert found(Y.complexity(n), "name", "complexity") == {("test_a", 3), ("inner", 2)}
    assert found(Y.fallback_symbols(n), "name", "kind") == {("Base", "class"), ("Mine", "class")}
    roots = spark.createDataFrame([(b,) for b in Y.UNITTEST_BASES], "base string")
    assert found(Y.descendants(Y.bases(n), roots), "name") == {"Base", "Mine"}
    assert n.join(Y.test_context(n), ["path", "id"]).where("name = 'go'").count() == 1
    outer = n.where("kind in ('ClassDef', 'FunctionDef')").select("path", F.col("name").alias("id"), "sl", "sc", "el", "ec")
    assert found(Y.qualified_container(outer, outer), "id", "container") == {("Base", None), ("Mine", None), ("test_a", "Mine"), ("inner", "test_a")}
    scopes = spark.createDataFrame([("p", "outer", "x", 0, 99), ("p", "inner", "x", 10, 20)], "path string, scope string, name string, lo int, hi int")
    uses = spark.createDataFrame([("p", 1, "x", 15), ("p", 2, "x", 50), ("p", 3, "y", 15)], "path string, use int, name string, at int")
    assert found(Y.scope_of(uses, scopes), "use", "scope") == {(1, "inner"), (2, "outer"), (3, None)}


def test_templates(spark):
    html = '<app-item *ngFor="let it of items" [value]="it.price | money" (click)="save(it)">{{ title }} {{ \'no\' }}</app-item>\n@if (ready) { <b>plain</b> }\n'
    files = spark.createDataFrame([("src/a.html", html)], "path string, text string")
    assert found(T.template_names(files), "name") == {"it", "items", "save", "title", "ready"}
    ts = spark.createDataFrame([("src/list.ts", "@Component({selector: 'app-list', templateUrl: './a.html'})\nexport class ListC {}"), ("src/item.ts", "@Component({selector: 'app-item', template: `<i>{{ name }}</i>`})\nclass ItemC {}")], "path string, text string")
    c = T.components(ts)
    assert found(c, "class", "selector", "linked", "template") == {("ListC", "app-list", "src/a.html", None), ("ItemC", "app-item", None, "<i>{{ name }}</i>")}
    assert found(T.component_uses(files, c), "path", "class") == {("src/a.html", "ItemC")}
    assert found(T.positioned(files, c).where("name in ('ready', 'save')"), "component", "ln", "name") == {("src/list.ts", 1, "ready"), ("src/list.ts", 0, "save")}
    assert found(T.asset_names(spark.createDataFrame([("m.xml", "Main")], "path string, name string"), T.template_names(files)), "key") >= {"Main", "save"}


def test_inputs(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.py\n\n b.py \n")
    assert found(I.path_list(spark, file=str(tmp_path / "list.txt")), "path") == {"a.py", "b.py"}
    assert [r["path"] for r in I.path_list(spark, many="x, y,,").collect()] == ["x", "y"]
    for bad in ({}, {"path": "a", "many": "b"}, {"many": " , "}):
        with pytest.raises(ValueError):
            I.path_list(spark, **bad)
    raw = spark.createDataFrame([("ok", bytearray(b"abc")), ("big", bytearray(b"x" * 50)), ("bin", bytearray(b"\xff\xfe"))], "path string, content binary")
    text, out = I.bounded_text(raw, 10)
    assert found(text, "path") == {"ok"} and found(out, "path", "reason") == {("big", "too_large"), ("bin", "not_utf8")}
    (tmp_path / "one.py").write_text("x = 1\n")
    assert I.read_file(spark, str(tmp_path / "one.py")).first()["lang"] == "python" and I.read_file(spark, str(tmp_path / "one.py"), 3).count() == 0
    p = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    assert [r["path"] for r in I.changed_files([p("b", "a"), p("a", "vendor/x", "Cargo.lock")]).collect()] == ["a", "b"]
    assert I.diff_source(spark, inline="x")[0].count() == 1
    skipped, why = I.diff_source(spark, root=str(tmp_path))
    assert skipped.count() == 0 and why == "not_a_git_repository"
    rules = "# rules\n- id: R1\n  language: python\n  severity: error\n  message: 'don''t'\n  pattern: foo\n- id: R2\n  language: rust\n  severity: warning\n  message: x\n  query: |\n    (a)\n    (b)\n- id: R3\n  language: go\n  severity: warning\n  message: y # no\n"
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "b.yaml").write_text(rules)
    (tmp_path / "rules" / "a.yml").write_text("- id: R0\n  language: go\n  severity: error\n  message: m\n  pattern: p\n  query: q\n")
    r = I.rules(spark, str(tmp_path / "rules"))
    assert [(x["id"], x["message"], x["query"]) for x in r.orderBy("ord").collect()] == [("R0", "m", "q"), ("R1", "don't", None), ("R2", "x", "(a)\n(b)"), ("R3", "y", None)]
    assert found(I.rule_warnings(r), "id", "warning") == {("R0", "both"), ("R3", "neither")}
    manifests = spark.createDataFrame([("package.json", '{"dependencies": {"react": "1", "@a/b": "2"}, "devDependencies": {"jest": "1"}}'), ("x/package.json", "no"), ("y.json", "{}")], "path string, text string")
    assert found(I.packages(manifests), "package") == {"react", "@a/b", "jest"}
    attrs = spark.createDataFrame([(".gitattributes", "*.gen.ts linguist-generated\ndocs/** linguist-generated=true\n# x linguist-generated\n"), ("src/.gitattributes", "a.gen.ts -linguist-generated\n")], "path string, text string")
    g = I.generated_by_attributes(p("a.gen.ts", "src/a.gen.ts", "src/b.gen.ts", "docs/x/y.md", "z.ts"), I.attribute_rules(attrs))
    assert found(g.where("generated"), "path") == {"a.gen.ts", "src/b.gen.ts", "docs/x/y.md"}
    assert found(I.for_liveness(p("a.py", "../b.py", "/c.py", "vendor/d.py", "e.md"), ["vendor"]), "path") == {"a.py"}
    heads = spark.createDataFrame([("a.py", "# Automatically Generated"), ("b.py", "x")], "path string, head string")
    assert found(I.for_interface(p("a.py", "b.py", "tests/c.py", "z.ts"), heads, p("z.ts").withColumn("generated", F.lit(True))), "path") == {"b.py"}
    assert I.only_folded(spark.createDataFrame([("php",), ("xojo",)], "lang string")) and not I.only_folded(spark.createDataFrame([], "lang string"))
    with pytest.raises(ValueError):
        I.checked_sources(p("a", "b", "c"), 2)
    cf = spark.createDataFrame([("s", "app/a"), ("s", "lib/b"), ("t", "lib/c")], "sha string, path string")
    assert found(I.within_workspace(cf, "app"), "sha", "path", "total") == {("s", "a", 2)}
    merged = FL.merged(p("a/b.py", "c.py"), p("a/./b.py", "d.py"))
    assert found(merged, "path") == {"a/b.py", "c.py", "d.py"}


def test_usage_log(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    log = [
        {"type": "user", "timestamp": "2025-01-02T10:00:00Z", "message": {"content": "do it"}},
        {"type": "assistant", "timestamp": "2025-01-03T10:00:00Z", "message": {"content": [{"type": "tool_use", "name": "Bash", "input": {"command": "ls -l"}}, {"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Grep", "input": {}}]}},
        {"type": "user", "message": {"content": [{"type": "text", "text": "more"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"command\": \"rg x\"}"}},
    ]
    (tmp_path / "proj" / "s.jsonl").write_text("\n".join(map(json.dumps, log)) + "\nnot json\n[1]\n\n")
    rows = I.usage_log(spark, str(tmp_path), "agent").cache()
    assert found(rows.where("tool is not null"), "tool", "command", "project", "day") == {("Bash", "ls -l", "proj", "2025-01-02"), ("Grep", None, "proj", "2025-01-02"), ("shell", "rg x", "proj", "2025-01-02")}
    assert found(rows.where("kind = 'user'"), "prompt") == {"do it", "more"}
    assert tuple(I.log_totals(rows).first()) == ("agent", 1, 1, 3, 5)


def test_git_inputs(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\nz = 3\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 5\nz = 3\nw = 4\n")
    lines = __import__("codestrata.sources.diffs", fromlist=["parse"]).parse(G.diff(spark, str(tmp_path)))
    r = I.old_ranges(lines)
    assert r.count() == 1
    blame = G.blame(spark, str(tmp_path), ["a.py"], moved=True)
    assert found(blame, "ln", "author_mail") == {(0, "a@b"), (1, "a@b"), (2, "a@b")}
    assert I.blamed(r, blame).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "ord int, name string").repartition(7)
    assert [json.loads(x)["name"] for x in K.ordered_lines(df)] == [f"n{i}" for i in range(50)]
    store = K.Store(spark, str(tmp_path / "store"))
    keyed = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, value string").select(K.content_key(F.col("k")).alias("key"), "value")
    hits, misses = store.get(keyed)
    assert hits.count() == 0 and misses.count() == 2
    store.put(keyed)
    store.put(keyed)  # again: still one answer a key
    hits, misses = store.get(keyed)
    assert hits.count() == 2 and misses.count() == 0
    spoiled = keyed.limit(1).select("key", F.lit("bad").alias("value"), F.lit(0).cast("long").alias("crc"))
    spoiled.write.mode("append").parquet(store.path)
    assert "bad" not in found(store.get(keyed)[0], "value")
    assert K.capabilities(spark).where("exact").count() == 1
    assert toon.encode({"m": {"a": {"x": 1, "y": "q"}, "b": {"x": 2, "y": "r"}}}) == "m[2:]{x,y}:\n  a: 1,q\n  b: 2,r"


def test_interface_rules(spark):
    names = spark.createDataFrame([("f", "a.py"), ("g", "a.py"), ("h", "a.py")], "name string, file string")
    refs = spark.createDataFrame([("a.py", "f", 1, False, True), ("b.py", "f", 4, False, False), ("b.py", "f", 1, True, False), ("a.py", "g", 9, False, False), ("c.py", "h", 2, True, False)], "path string, name string, ln int, is_import boolean, is_definition boolean")
    added = spark.createDataFrame([("b.py", 4), ("b.py", 1)], "path string, line int")
    assert found(A.index(names, refs, added), "name", "internal", "external", "defined", "unused", "closed") == {("f", 0, 2, 1, False, True), ("g", 1, 0, 0, True, False), ("h", 0, 1, 0, False, False)}
    imports = spark.createDataFrame([("b.py", "f", "@x/y/z"), ("c.py", "h", "./own")], "path string, binding string, module string")
    packages = spark.createDataFrame([("@x/y",)], "package string")
    assert A.without_external(refs, imports, packages).where("path = 'b.py'").count() == 0
    removed = spark.createDataFrame([("T", "a", None), ("m", "a", "T"), ("k", "a", None), ("p", "a", None), ("two", "a", None)], "name string, file string, owner string")
    left = spark.createDataFrame([("k", "b", False), ("p", "b", False), ("two", "b", True), ("two", "c", True)], "name string, path string, is_definition boolean")
    origins = spark.createDataFrame([("p", "b", True), ("k", "b", False)], "name string, path string, proved boolean")
    types = spark.createDataFrame([("T", "a")], "name string, file string")
    assert found(A.removed_dead(removed, left, origins, types), "name", "fate") == {("T", "dead"), ("m", "dead"), ("k", "kept"), ("p", "dead"), ("two", "kept")}
    changed = spark.createDataFrame([("src/util.ts",)], "path string")
    di = A.direct_imports(spark.createDataFrame([("x.ts",), ("y.ts",)], "path string"), spark.createDataFrame([("x.ts", "../src/util"), ("y.ts", "react")], "path string, module string"), changed)
    assert found(di, "path", "direct_import") == {("x.ts", True), ("y.ts", False)}
    members = spark.createDataFrame([("A", "m"), ("A", "n"), ("B", "m"), ("B", "t"), ("B", "z")], "owner string, name string")
    uses = spark.createDataFrame([("A", "m", False), (None, "m", False), ("B", "t", True)], "receiver string, name string, is_test boolean")
    assert found(A.member_liveness(members, uses), "owner", "name", "status") == {("A", "m", "live"), ("B", "m", "ambiguous"), ("A", "n", "dead"), ("B", "t", "test-only"), ("B", "z", "dead")}
    lines = A.declaration_lines(spark.createDataFrame([("p", "C.m"), ("p", "f")], "path string, name string"), spark.createDataFrame([("p", "m", 7), ("p", "m", 3), ("p", "f", 1)], "path string, name string, ln int"))
    assert found(lines, "name", "line") == {("C.m", 3), ("f", 1)}
    callers = spark.createDataFrame([("x", 1, "C.m", "go", "a"), ("x", 2, "f", "go", "a")], "path string, line int, symbol string, caller string, source string")
    kept = A.without_competing(callers, spark.createDataFrame([("C.m", "a", "C"), ("f", "a", None)], "symbol string, source string, owner string"), spark.createDataFrame([("C.m", "b"), ("f", "b")], "symbol string, path string"))
    assert found(kept, "symbol") == {"f"}
    merged = A.with_same_file(callers, spark.createDataFrame([("a", "own", "f", 5), ("a", "f", "f", 6)], "path string, caller string, callee string, ln int"), spark.createDataFrame([("a", "f")], "path string, symbol string"))
    assert [tuple(r) for r in merged.collect()] == [("a", 5, "f", "own"), ("x", 1, "C.m", "go"), ("x", 2, "f", "go")]
    mods = spark.createDataFrame([("root", "a", True), ("a", "b", True), ("root", "p", False)], "parent string, module string, public boolean")
    ex = spark.createDataFrame([("b", "p")], "module string, target string")
    assert found(A.visible_modules(mods, ex, spark.createDataFrame([("root",)], "module string")), "module") == {"root", "a", "b", "p"}
    traits = A.trait_targets(spark.createDataFrame([("C", "T"), ("T", "U")], "class string, trait string"), spark.createDataFrame([("T", "m"), ("U", "n")], "trait string, method string"))
    assert found(traits.where("class = 'C'"), "method") == {"m", "n"}
    fields = spark.createDataFrame([("C", "x", "f")], "class string, name string, file string")
    assert A.property_to_field(spark.createDataFrame([("C", "x", "f"), ("C", "y", "f")], "class string, name string, file string"), fields).count() == 1


def test_signature_chain(spark):
    no = F.lit(False)
    cases = [
        ("same", "typescript", "f", "export function f(a: number)", "export  function f(a: number)"),
        ("same", "rust", "f", "pub fn f(state: State<'_, Db>, a: u8)", "pub fn f(a: u8)"),
        ("same", "tsx", "F", "function F({ a }: Props)", "function F({ a, b }: Props)"),
        ("wrapper", "tsx", "F", "export const F = (p: P)", "export const F = memo((p: P))"),
        ("unused-members", "typescript", "o", "export const o = { a: 1, b: 2 }", "export const o = { a: 1 }"),
        ("modified", "typescript", "o", "export const o = { a: 1, used: 2 }", "export const o = { a: 1 }"),
        ("optional-members", "typescript", "I", "interface I { used: string }", "interface I { used: string; b?: number }"),
        ("async-component", "tsx", "Page", "export function Page(p: P)", "export async function Page(p: P)"),
        ("optional-tail", "typescript", "f", "function f(a: A)", "function f(a: A, b?: B)"),
        ("python-tail", "python", "f", "def f(a):", "def f(a, b=1):"),
        ("optional-argument", "javascript", "f", "function f()", "function f({ a } = {})"),
        ("modified", "python", "f", "def f(a):", "def f(a, b):"),
        ("modified", "go", "f", "func f(a int)", "func f(a string)"),
    ]
    df = spark.createDataFrame(cases, "want string, lang string, name string, old string, new string")
    got = df.select("want", "name", "old", A.classify(F.lit("function"), F.col("lang"), F.col("name"), F.col("old"), F.col("new"), no, F.array(F.lit("used")), F.lit(True)).alias("got")).collect()
    assert [(r["got"], r["old"]) for r in got] == [(r["want"], r["old"]) for r in got]
    more = spark.range(1).select(A.required_members(F.lit("{ a: x }"), F.lit("{ a: x, b: y, c?: z }"))).first()
    assert tuple(more) == (["b"],)


OLD = {"lib.py": "def used(a):\n    return a\n\n\ndef gone():\n    return 1\n\n\ndef tail(a):\n    return a\n", "app.py": "from lib import used\n\n\ndef main():\n    return used(1)\n", "tests/test_lib.py": "from lib import used\n\n\ndef test_used():\n    assert used(2)\n"}
NEW = OLD | {"lib.py": "def used(a, b):\n    return a + b\n\n\ndef tail(a, c=1):\n    return a\n\n\ndef fresh():\n    return 3\n"}


def test_review(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")

    def write(tree):
        for p, t in tree.items():
            os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
            (tmp_path / p).write_text(t)

    write(OLD)
    run("add", "."), run("commit", "-qm", "one")
    write(NEW)
    trees = [spark.createDataFrame([(p, "python", t) for p, t in tree.items()], FILES) for tree in (OLD, NEW)]
    r = V.review(*trees, G.diff(spark, str(tmp_path)))
    assert {"used", "tail"} <= found(r["affected"], "name")
    assert found(r["callers"].where("route = 'normal'").select("path", "line", F.explode("symbols").alias("s")), "path", "line", "s") == {("app.py", 4, "used")}
    assert found(r["impact"].select("path", F.explode("symbols").alias("s")), "path", "s") == {("app.py", "used")}
    assert found(r["dead"], "name", "status") >= {("fresh", "dead")} and "used" not in found(r["dead"], "name")
    assert found(r["api"], "name", "change", "verdict") == {("used", "modified", "modified"), ("gone", "removed", None), ("tail", "modified", "python-tail"), ("fresh", "added", None)}
    out = r["hook"].first()
    got = json.loads(out["json"])
    # Nothing uses what is gone: that informs, it doesn't block.
    assert out["blocking"] and got["blocking"] and got["impacts"] == [{"f": "app.py", "syms": ["used"]}] and "rm" not in got and got["rm_dead"] == [{"n": "gone", "f": "lib.py"}] and got["mod_compat"] == [{"n": "tail", "f": "lib.py", "reason": "python-tail"}]
    nothing = V.review(*trees, spark.createDataFrame([], "diff_id string, text string"))
    assert nothing["hook"].first()["blocking"] is False and nothing["affected"].count() == 0
