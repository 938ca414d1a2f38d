"""Callers that follow a change through a constant of their file."""

from pyspark.sql import functions as F

from codestrata.operators import constants as K

FILES = "path string, lang string, text string"


def test_what_is_required(spark):
    cases = [
        ("function f(d: { a: A }) {", "function f(d: { a: A; b: B }) {", (0, ["b"])), ("function f(x: X, d: { a: A }) {", "function f(x: X, d: { a: A; b: B; c: C }) {", (1, ["b", "c"])),
        ("function f(d: { a: A }) {", "function f(d: { a: A; b?: B }) {", None), ("function f(d: { a: A }) {", "function f(d: { a: Z; b: B }) {", None), ("function f(d: { a: A }, y: Y) {", "function f(d: { a: A; b: B }, y: Z) {", None),
        ("function f(d: { a: A; b: B }) {", "function f(d: { b: B; c: C }) {", None), ("function f(d: D) {", "function f(d: E) {", None), ("function f() {", "function f(d: { a: A }) {", None), ("const x = 1", "const x = 2", None),
    ]
    df = spark.createDataFrame([(i, o, n) for i, (o, n, _) in enumerate(cases)], "i int, o string, n string")
    got = {r["i"]: r["r"] and (r["r"]["index"], list(r["r"]["keys"])) for r in df.select("i", K.added_required(F.col("o"), F.col("n")).alias("r")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


CASES = {
    "plain.ts": ("import { build } from './b';\nconst DEPS = {\n  a: 1,\n  b: 2,\n};\nbuild(DEPS);\n", [3], {(5, 0)}),
    "typed.ts": ("const DEPS: T = { a: 1,\n  b: 2 };\nrun(build(DEPS, other(x)));\n", [1], {(2, 4)}),
    "short.ts": ("const DEPS = { a,\n  b };\nbuild(DEPS);\n", [1], {(2, 0)}),
    "before.ts": ("const DEPS = { a: 1, b: 2 };\nbuild(DEPS);\n", [5], set()),
    "missing.ts": ("const DEPS = { a: 1,\n c: 2 };\nbuild(DEPS);\n", [1], set()),
    "spread.ts": ("const DEPS = { a: 1,\n b: 2 };\nbuild(...DEPS);\nbuild(DEPS, ...rest);\n", [1], set()),
    "member.ts": ("const DEPS = { a: 1,\n b: 2 };\nbuild(DEPS.x);\nbuild({ ...DEPS });\nbuild(make(DEPS));\no.build(DEPS);\n", [1], set()),
    "shadow.ts": ("const DEPS = { a: 1,\n b: 2 };\nfunction g(DEPS) {\n  build(DEPS);\n}\n", [1], set()),
    "pattern.ts": ("const DEPS = { a: 1,\n b: 2 };\nfunction g({ deps: DEPS }) {}\nbuild(DEPS);\n", [1], set()),
    "default.ts": ("const DEPS = { a: 1,\n b: 2 };\nfunction g(other = DEPS) {}\nbuild(DEPS);\n", [1], {(3, 0)}),
    "assigned.ts": ("const DEPS = { a: 1,\n b: 2 };\nDEPS = other;\nbuild(DEPS);\n", [1], set()),
    "let.ts": ("let DEPS = { a: 1,\n b: 2 };\nbuild(DEPS);\n", [1], set()),
    "imported.ts": ("import { DEPS } from './d';\nbuild(DEPS);\n", [0, 1], set()),
    "second.ts": ("const DEPS = { a: 1,\n b: 2 };\nbuild(x, DEPS);\n", [1], set()),
    "nested.ts": ("const DEPS = { a: { b: 1 },\n c: { b: 2 } };\nbuild(DEPS);\n", [0, 1], set()),
    "plain.js": ("const DEPS = { a: 1,\n b: 2 };\nbuild(DEPS);\n", [1], set()),
}


def test_followed(spark):
    files = spark.createDataFrame([(p, "typescript" if p.endswith("ts") else "javascript", t) for p, (t, _, _) in CASES.items()] + [("n.ts", "typescript", None)], FILES)
    added = spark.createDataFrame([(p, ln) for p, (_, lines, _) in CASES.items() for ln in lines], "path string, line int")
    wanted = spark.createDataFrame([("build", 0, ["b"])], "name string, index int, keys array<string>")
    got = {}
    for r in K.followed(files, wanted, added).collect():
        got.setdefault(r["path"], set()).add((r["ln"], r["col"]))
    assert got == {p: s for p, (_, _, s) in CASES.items() if s}
