"""What names mean in JavaScript and TypeScript: cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from codestrata.operators import scopes as S

#: (text, name, line, column, kind of what it means)
CASES = {
    "callback.ts": ("function startRecording() {}\nregister(() => {\n  startRecording();\n});\n", [("startRecording", 2, 2, "function")]),
    "import.ts": ("import { startRecording } from './api';\nstartRecording();\n", [("startRecording", 1, 0, "other")]),
    "renamed.ts": ("import def, { a as b, type T } from './api';\nimport * as ns from 'x';\na; b; def; ns; T;\n", [("a", 2, 0, None), ("b", 2, 3, "other"), ("def", 2, 6, "other"), ("ns", 2, 11, "other")]),
    "method.ts": ("import { start } from './api';\nclass A {\n  start() { return 1; }\n  go(): void { start(); this.start(); }\n}\n", [("start", 3, 15, "other")]),
    "variable.ts": ("const run = make();\nrun();\n", [("run", 1, 0, "other")]),
    "parameter.ts": ("function run() {}\nfunction go(run) {\n  run();\n}\nrun();\n", [("run", 2, 2, "other"), ("run", 4, 0, "function")]),
    "property.ts": ("function run() {}\nobj.run();\n", []),
    "pattern.ts": ("function run() {}\nfunction go({ run, key: other = run2 }) { run(); key(); other(); }\nconst h = ({ a: [run] }) => run();\n", [("run", 1, 42, "other"), ("key", 1, 49, None), ("other", 1, 56, "other"), ("run", 2, 28, "other")]),
    "block.ts": ("if (flag) {\n  function run() {}\n  run();\n}\nrun();\n", [("run", 2, 2, "function"), ("run", 4, 0, None)]),
    "switch.ts": ("switch (x) {\n  case 1:\n    function run() {}\n}\nrun();\n", [("run", 4, 0, None)]),
    "forof.ts": ("function run() {}\nfor (const run of runs) {\n  run();\n}\nrun();\n", [("run", 2, 2, "other"), ("run", 4, 0, "function")]),
    "forone.ts": ("function run() {}\nfor (const run of runs) run();\nrun();\n", [("run", 1, 24, "other"), ("run", 2, 0, "function")]),
    "forpattern.ts": ("function run() {}\nfor (const { run } of runs) {\n  run();\n}\n", [("run", 2, 2, "other")]),
    "forinit.ts": ("function run() {}\nfor (let run = first(); run; run = next(run)) {\n  run();\n}\nrun();\n", [("run", 2, 2, "other"), ("run", 4, 0, "function")]),
    "forvar.ts": ("function outer() {\n  for (var run of runs) {}\n  run();\n}\nfunction run() {}\nrun();\n", [("run", 2, 2, "other"), ("run", 5, 0, "function")]),
    "var.ts": ("function run() {}\nfunction outer() {\n  if (a) { var run = b; }\n  run();\n}\n", [("run", 3, 2, "other")]),
    "let.ts": ("function run() {}\nfunction outer() {\n  if (a) { let run = b; }\n  run();\n}\n", [("run", 3, 2, "function")]),
    "catch.ts": ("function err() {}\ntry { a(); } catch (err) { err(); }\nerr();\n", [("err", 1, 27, "other"), ("err", 2, 0, "function")]),
    "named.ts": ("const f = function run() { run(); };\nrun();\n", [("run", 0, 27, "other"), ("run", 1, 0, None)]),
    "class.ts": ("class run {}\nnew run();\nconst C = class Inner {};\nInner;\n", [("run", 1, 4, "other"), ("Inner", 3, 0, None)]),
    "several.ts": ("const a = f(x, y), run = 2;\nrun; x; y;\n", [("run", 1, 0, "other"), ("x", 1, 5, None), ("y", 1, 8, None)]),
    "arrow.ts": ("function x() {}\nconst g = x => x + 1, h = (y): T => y;\nx(); y();\n", [("x", 1, 15, "other"), ("y", 1, 36, "other"), ("x", 2, 0, "function"), ("y", 2, 5, None)]),
    "typed.ts": ("export default async function run(a: Opts = b, ...rest: T[]): Promise<X> {\n  a; rest; Opts; run();\n}\n", [("a", 1, 2, "other"), ("rest", 1, 5, "other"), ("Opts", 1, 11, None), ("run", 1, 17, "function")]),
    "generator.js": ("function* gen() { gen(); }\n", [("gen", 0, 18, "function")]),
    "object.js": ("function run() {}\nconst o = { run() { return run(); }, run: 1, go: function () { return run; } };\n", [("run", 1, 27, "function"), ("run", 1, 70, "function")]),
    "unicode.js": ("function é1() {}\nfunction run() {} const s = 'é'; run();\n", [("run", 1, 34, "function")]),
    "lines.js": ("const a = x => x\nfunction x() {}\nx()\n", [("x", 0, 15, "other"), ("x", 2, 0, "function")]),
}


@pytest.fixture(scope="module")
def resolved(spark):
    files = [(p, "typescript" if p.endswith("ts") else "javascript", t) for p, (t, _) in CASES.items()] + [("n.ts", "typescript", None), ("e.ts", "typescript", ""), ("p.py", "python", "def run(): run()")]
    df = spark.createDataFrame(files, "path string, lang string, text string").repartition(5)
    return {(r["path"], r["name"], r["ln"], r["col"]): r for r in S.resolve(df).collect()}


@pytest.mark.parametrize("path", sorted(CASES))
def test_names(resolved, path):
    for name, ln, col, kind in CASES[path][1]:
        assert (path, name, ln, col) in resolved, (path, name, ln, col, [k for k in resolved if k[0] == path])
        assert resolved[path, name, ln, col]["kind"] == kind, (path, name, ln, col, resolved[path, name, ln, col])


def test_members_and_other_files_have_no_rows(resolved):
    assert ("property.ts", "run", 1, 4) not in resolved
    assert {k[0] for k in resolved} <= set(CASES)


def test_references_without_shadowed(spark):
    text, _ = CASES["parameter.ts"]
    files = spark.createDataFrame([("a.ts", "typescript", text)], "path string, lang string, text string")
    refs = spark.createDataFrame([("a.ts", "run", 4, 0, 1), ("a.ts", "run", 2, 2, 2), ("b.ts", "run", 4, 0, 3)], "path string, name string, ln int, col int, n int")
    assert sorted(r["n"] for r in S.without_shadowed(refs, files).collect()) == [2, 3]


def test_long_files_are_linear(spark):
    import time

    text = "function run() {}\n" + "".join(f"function f{i}(a{i}) {{ const b{i} = a{i}; run(b{i}); }}\n" for i in range(4000))
    files = spark.createDataFrame([("a.js", "javascript", text)], "path string, lang string, text string")
    began = time.time()
    got = S.resolve(files).where((F.col("name") == "run") & (F.col("kind") == "function")).count()
    assert got == 4001 and time.time() - began < 120
