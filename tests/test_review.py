"""Reviews that must block, and that must not."""

import difflib
import json

import pytest

from codestrata.operators import lexing as X
from codestrata.operators import review as V

FILES = "path string, lang string, text string"
LANG = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "kt": "kotlin", "java": "java", "xojo_code": "xojo"}


def unified(old, new):
    out = []
    for p in sorted(old.keys() | new.keys()):
        a, b = old.get(p, ""), new.get(p, "")
        if a != b:
            out.append(f"diff --git a/{p} b/{p}")
            names = ["/dev/null" if p not in old else f"a/{p}", "/dev/null" if p not in new else f"b/{p}"]
            out += [x.rstrip("\n") for x in difflib.unified_diff(a.splitlines(), b.splitlines(), *names, lineterm="")]
    return "\n".join(out) + "\n"


def reviewed(spark, old, new):
    trees = [spark.createDataFrame([(p, LANG[p.rsplit(".", 1)[1]], t) for p, t in tree.items()], FILES) for tree in (old, new)]
    r = V.review(*trees, spark.createDataFrame([("d", unified(old, new))], "diff_id string, text string"))
    row = r["hook"].first()
    return r, json.loads(row["json"]), row["blocking"]


OLD = {
    # An object loses a key that another file reads, another one a key that nobody does.
    "cfg.ts": "export const cfg = { a: 1, b: 2 };\n", "use.ts": "import { cfg } from './cfg';\nconsole.log(cfg.b);\n", "opt.ts": "export const opt = { c: 1, d: 2 };\nconsole.log(opt.c);\n",
    # Of two names that go one is still used.
    "lib.py": "def kept():\n    return 1\n\n\ndef gone():\n    return 2\n", "app.py": "from lib import kept\n\n\ndef main():\n    return kept()\n", "tests/test_app.py": "from app import main\n\n\ndef test_main():\n    main()\n",
    # All callers of what changes are changed along; another file has a function of that name for itself.
    "send.ts": "export function send(a: string) { return a; }\n", "call.ts": "import { send } from './send';\nsend('x');\n", "own.ts": "function send(b) { return b; }\nexport const q = () => send(3);\nconsole.log(q);\n",
    # A caller that stays as it is.
    "post.ts": "export function post(a: string) { return a; }\n", "stale.ts": "import { post } from './post';\npost('x');\n",
    # A caller that stays as it is, but passes a constant that gets the new entry.
    "dep.ts": "export function build(d: { a: number }) { return d; }\n", "made.ts": "import { build } from './dep';\nconst DEPS = {\n  a: 1,\n};\nbuild(DEPS);\n",
    # Something that overrides.
    "K.java": "class K {\n  @Override\n  public String toString() {\n    return \"a\";\n  }\n}\n",
}
NEW = OLD | {
    "cfg.ts": "export const cfg = { a: 1 };\n", "opt.ts": "export const opt = { c: 1 };\nconsole.log(opt.c);\n", "lib.py": "X = 1\n", "app.py": "from lib import kept, X\n\n\ndef main():\n    return kept() + X\n",
    "send.ts": "export function send(a: string, b: number) { return a; }\n", "call.ts": "import { send } from './send';\nsend('x', 1);\n", "post.ts": "export function post(a: string, b: number) { return a; }\n",
    "dep.ts": "export function build(d: { a: number; b: number }) { return d; }\n", "made.ts": "import { build } from './dep';\nconst DEPS = {\n  a: 1,\n  b: 2,\n};\nbuild(DEPS);\n",
    # What only a runtime calls, or is private, is not dead.
    "k.py": "class K:\n    def __init__(self):\n        self.a = 1\n\n    def __len__(self):\n        return self.a\n\n    def _own(self):\n        return 1\n\n    def shown(self):\n        return 2\n\n\nK()\n",
    "t.xojo_code": "Class FooTests\nInherits TestGroup\n\tSub barTest()\n\tEnd Sub\n\tSub helperUtil()\n\tEnd Sub\nEnd Class\nClass User\nInherits FooTests\nEnd Class\nDim u As New User\n",
}


def test_review_blocks_what_breaks_and_nothing_else(spark):
    r, got, blocking = reviewed(spark, OLD, NEW)
    api = r["api"].collect()
    assert {x["name"]: x["verdict"] for x in api if x["change"] == "modified"} == {"cfg": "modified", "opt": "unused-members", "send": "closed", "post": "modified", "build": "closed"}
    assert {x["name"]: x["fate"] for x in api if x["change"] == "removed"} == {"kept": "kept", "gone": "dead"}
    assert {x["name"] for x in r["dead"].collect()} == {"shown", "helperUtil"}
    assert blocking and got["mod"] == [{"n": "cfg", "f": "cfg.ts"}, {"n": "post", "f": "post.ts"}]
    assert got["rm"] == [{"n": "kept", "f": "lib.py"}] and got["rm_dead"] == [{"n": "gone", "f": "lib.py"}]


def test_overriding_is_read_before_the_name(spark):
    files = spark.createDataFrame([("K.java", "java", OLD["K.java"]), ("k.py", "python", "class A(B):\n    @override\n    def f(self):\n        pass\n\n    def g(self):\n        pass\n")], FILES)
    s = V.heads(V.symbol_rows(files), files)
    got = {x["name"]: x["o"] for x in s.select("name", X.overrides(s["head"], s["lang"]).alias("o")).collect()}
    assert got == {"K": False, "A": False, "f": True, "g": False}


@pytest.mark.parametrize("partitions", [1, 7])
def test_first_overload_counts_however_files_lie(spark, partitions):
    files = [("a.ts", "typescript", "export function f(a: string): void;\nexport function f(a: number): void;\nexport function f(a: any) {}\n"), ("b.ts", "typescript", "export const z = 1;\n")]
    make = lambda rows: spark.createDataFrame(rows, FILES).repartition(partitions)
    new = [(files[0][0], files[0][1], files[0][2].replace("a: string", "a: Date")), files[1]]
    got = V.interface(make(files), make(new)).collect()
    assert [(r["name"], r["old_signature"], r["new_signature"]) for r in got] == [("f", "export function f(a: string): void;", "export function f(a: Date): void;")]


def test_dead_code_with_totals(spark):
    from codestrata.sources import diffs as D

    new = {"a.py": "def lonely():\n    return 1\n\n\ndef busy():\n    return 2\n", "b.py": "from a import busy\n\n\nbusy()\n"}
    files = spark.createDataFrame([(p, "python", t) for p, t in new.items()] + [("c.txt", None, "x")], FILES)
    lines = D.parse(spark.createDataFrame([("d", unified({}, new))], "diff_id string, text string"))
    rows, errors, totals = V.dead_report(files, lines)
    assert [(r["name"], r["status"]) for r in rows.collect()] == [("lonely", "dead")]
    assert errors.count() == 0 and totals == {"files": 2, "passed_over": 1, "rows": 2, "timeouts": 0, "failures": 0}


def test_joins_of_a_review_trust_no_estimate(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    key, seen, run = "spark.sql.autoBroadcastJoinThreshold", [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a, **k: (seen.append(spark.conf.get(key)), run(df, *a, **k))[1])
    before = spark.conf.get(key)
    old, new = (spark.createDataFrame([("a.py", "python", t)], FILES) for t in ("def f():\n    return 1\n", "def g():\n    return 1\n"))
    assert {(r["name"], r["change"]) for r in V.interface(old, new).collect()} == {("f", "removed"), ("g", "added")}
    assert seen and set(seen) == {"-1"} and spark.conf.get(key) == before


def test_a_side_that_only_looks_small_is_not_broadcast(spark):
    from pyspark.sql import functions as F

    from codestrata.config import measured_joins

    # Each of 200 rows becomes 1000, which no estimate knows.
    small = spark.range(200).select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("n"), "id")
    grown = small.select((F.col("id") * 1000 + F.col("n")).alias("k"), F.lit("x" * 40).alias("text"))
    plans = []
    with measured_joins(spark):
        for most in (200_000, 10):
            joined = spark.range(300_000).withColumnRenamed("id", "k").join(grown.where(F.col("k") < most), "k")
            assert joined.count() == most
            joined.collect()
            plans.append(str(joined._jdf.queryExecution().executedPlan()))
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in plans[1].split("Initial Plan")[0]
