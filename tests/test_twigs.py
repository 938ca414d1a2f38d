"""Structural rules over node tables, and trait dispatch: cases by hand and against brute force."""

import itertools
import random
from collections import Counter

import pytest

from codestrata.operators import api as A
from codestrata.operators import graph as G
from codestrata.operators import syntax as Y
from codestrata.operators import twigs as W
from codestrata.sources import inputs as I

SOURCE = """import os
def outer(a, b):
    def inner():
        return eval(a)
    try:
        eval(b)
    except ValueError:
        pass
    return os.system(b)
class K:
    def outer(self):
        print(eval)
"""
RULE = "id string, language string, severity string, message string, query string, pattern string"


@pytest.fixture(scope="module")
def nodes(spark):
    files = spark.createDataFrame([("a.py", "python", SOURCE), ("b.py", "python", "def f(: pass"), ("c.py", "python", ""), ("d.py", "python", None), ("e.rs", "rust", "fn a() {}")], "path string, lang string, text string")
    return Y.nodes(files).cache()


def lines(found, rule):
    return sorted(r["ln"] for r in found if r["rule_id"] == rule)


def test_rules(spark, nodes, tmp_path):
    (tmp_path / "r.yaml").write_text(
        '- id: eval\n  language: python\n  severity: error\n  message: "no eval"\n  query: |\n    (Call func: (Name) @f\n      (#eq? @f "eval"))\n'
        "- id: anywhere\n  language: python\n  severity: info\n  message: m\n  query: '(FunctionDef ..(Name) @n (#eq? @n \"eval\"))'\n"
        "- id: named\n  language: python\n  severity: info\n  message: m\n  pattern: outer\n"
        "- id: js\n  language: javascript\n  severity: info\n  message: m\n  pattern: outer\n"
        "- id: both\n  language: python\n  severity: info\n  message: m\n  pattern: outer\n  query: (ClassDef) @c\n"
        "- id: neither\n  language: python\n  severity: info\n  message: m\n"
        "- id: wrong\n  language: python\n  severity: info\n  message: m\n  query: (NoSuchNode) @x\n"
    )
    found, warned = W.lint(nodes, I.rules(spark, str(tmp_path)))
    got = found.collect()
    assert lines(got, "eval") == [3, 5]
    assert {(r["severity"], r["message"], r["name"], r["col"]) for r in got if r["rule_id"] == "eval"} == {("error", "no eval", "eval", 15), ("error", "no eval", "eval", 8)}
    # Each enclosing function makes a match: line 3 lies in two.
    assert lines(got, "anywhere") == [3, 3, 5, 11]
    assert lines(got, "named") == [1, 10] and lines(got, "js") == [] and lines(got, "both") == [9] and lines(got, "neither") == []
    assert {r["id"]: r["warning"].split(";")[0].split(":")[0] for r in warned.collect()} == {"both": "query and pattern are mutually exclusive", "neither": "must have either query or pattern", "wrong": "invalid query"}


def test_nodes_are_made_once_and_no_side_is_broadcast(spark, nodes):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rules = spark.createDataFrame([(str(k), "python", "info", "m", q, None) for k, q in enumerate(["(FunctionDef ..(Call func: (Name) @f) @c) @d", "(Call) @c"])], RULE)
    every = nodes.count()
    found, _ = W.lint(nodes.mapInPandas(counted, nodes.schema), rules)
    got = Counter((r["rule_id"], r["capture"], r["ln"], r["name"]) for r in found.collect())
    assert {k: n for k, n in got.items() if k[1] == "d"} == {("0", "d", 1, "outer"): 2, ("0", "d", 2, "inner"): 1, ("0", "d", 10, "outer"): 1}
    assert sum(n for k, n in got.items() if k[0] == "1") == 4 and read.value == every
    assert "BroadcastHashJoin" not in str(found._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("query", ["", "Call", "(Call", "(Call))", "(Call (#eq? @x \"a\"))", "(Call @)", "(Call (#like? @c \"a\")) @c", "(Call (#match? @c \"(\")) @c", "(Call !) @c"])
def test_no_patterns(query):
    with pytest.raises(ValueError):
        W.twig(query)


def brute(rows, pattern):
    """All choices of nodes for the pattern's, by trying them."""
    by = {r["id"]: r for r in rows}

    def fits(t, r):
        if t.kind not in ("_", r["kind"]) or t.field is not None and t.field != r["field"]:
            return False
        tests = [(p, x) for p, c, x in pattern.tests if c == t.capture]
        return all({"#eq?": r["name"] == x, "#not-eq?": r["name"] != x}[p] for p, x in tests)

    def below(i, j):
        while by[j]["parent"] is not None:
            j = by[j]["parent"]
            if j == i:
                return True
        return False

    def solve(t, r):
        if not fits(t, r):
            return
        options = []
        for b in t.below:
            near = [x for x in rows if (below(r["id"], x["id"]) if b.deep else x["parent"] == r["id"])]
            options.append([(x["id"], s) for x in near for s in solve(b, x)])
        for choice in itertools.product(*options):
            if len({c[0] for c in choice}) == len(choice):
                yield (r["id"], *[n for c in choice for n in c[1]])

    return sorted(s for r in rows for s in solve(pattern, r))


@pytest.mark.parametrize("query", [
    "(Call) @c", "(If (Call) @a (Call) @b)", "(If ..(Call) @a)", "(_ body: (If ..(Call) @a (Name)))", "(Module ..(If (If) @i ..(Call) @c (#eq? @c \"x\")))", "(If (_) @a (_) @b (#not-eq? @a \"x\"))",
])
def test_twigs_equal_brute_force(spark, query):
    rng = random.Random(len(query))
    rows = [(0, None, "Module", None, None)]
    while len(rows) < 40:
        parent = rng.randrange(len(rows))
        rows.append((len(rows), parent, rng.choice(["If", "Call", "Name"]), rng.choice(["x", "y", None]), rng.choice(["body", "test"])))
    below = {i: [r[0] for r in rows if r[1] == i] for i in range(len(rows))}
    order = []
    stack = [0]
    while stack:  # numbers in order of the text
        i = stack.pop()
        order.append(i)
        stack += below[i][::-1]
    at = {i: k for k, i in enumerate(order)}
    renumbered = sorted((at[i], None if p is None else at[p], k, n, f) for i, p, k, n, f in rows)
    numbered = Y.numbered([("p", i, p, k, n, f) for i, p, k, n, f in renumbered])
    df = spark.createDataFrame(numbered, "path string, id int, last int, parent int, kind string, name string, field string")
    df = df.union(df.selectExpr("'q' as path", "id", "last", "parent", "kind", "name", "field"))
    pattern = W.twig(query)
    got = sorted(tuple(r)[1:] for r in W.matches(df, pattern).where("path = 'q'").selectExpr("path", *[f"n{k}" for k in range(len(pattern.all()))]).collect())
    assert got == brute([r.asDict() for r in df.where("path = 'q'").collect()], pattern)


def dispatch(owner, method, targets, uses, declared, unclear):
    """The walk, one call at a time, deepest first."""
    found, doubt = set(), [False]

    def walk(node, path):
        if (node, method) in targets:
            found.add(node)
            return
        traits = [t for c, t in uses if c == node]
        if not traits or (node, method) in declared:
            return
        if node in path:
            doubt[0] = True
            return
        if node in unclear:
            doubt[0] = True
        for t in traits:
            walk(t, path | {node})

    walk(owner, frozenset())
    if not found:
        return "none", None
    return ("ambiguous", None) if doubt[0] or len(found) > 1 else ("resolved", found.pop())


CHAIN = [("C", "T1"), ("T1", "T2"), ("T2", "T3"), ("T3", "T4"), ("T4", "T5"), ("L", "M"), ("M", "L"), ("M", "T5"), ("S", "T1"), ("A", "T5"), ("W", "T5"), ("W", "U5"), ("X", "X")]


def test_dispatch_by_hand(spark):
    targets, declared, unclear = [("T5", "m"), ("U5", "m")], [("T2", "n"), ("S", "m"), ("T3", "k")], ["A"]
    calls = [("C", "m"), ("L", "m"), ("S", "m"), ("A", "m"), ("W", "m"), ("X", "m"), ("T5", "m"), ("gone", "m"), ("C", "n"), ("C", "k"), (None, "m"), ("C", None)]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    got = {(r["class"], r["method"]): (r["state"], r["target"]) for r in A.trait_dispatch(
        make(calls, "class string, method string"), make(targets, "type string, method string"), make(CHAIN, "class string, trait string"),
        make(declared, "class string, method string"), make([(u,) for u in unclear], "class string")).collect()}
    assert got == {(c, m): dispatch(c, m, set(targets), CHAIN, set(declared), set(unclear)) for c, m in calls if c and m}
    assert got["C", "m"] == ("resolved", "T5") and got["L", "m"][0] == "ambiguous" and got["S", "m"][0] == "none" and got["A", "m"][0] == "ambiguous" and got["W", "m"][0] == "ambiguous" and got["X", "m"][0] == "none"


@pytest.mark.parametrize("seed", [1, 2])
def test_dispatch_equals_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i}" for i in range(14)]
    uses = sorted({(rng.choice(names), rng.choice(names)) for _ in range(18)})
    targets = sorted({(rng.choice(names), rng.choice("mn")) for _ in range(5)})
    declared = sorted({(rng.choice(names), rng.choice("mn")) for _ in range(3)})
    unclear = [rng.choice(names)]
    calls = [(c, m) for c in names for m in "mn"]
    got = {(r["class"], r["method"]): (r["state"], r["target"]) for r in A.trait_dispatch(
        spark.createDataFrame(calls, "class string, method string"), spark.createDataFrame(targets, "type string, method string"), spark.createDataFrame(uses, "class string, trait string"),
        spark.createDataFrame(declared, "class string, method string"), spark.createDataFrame([(u,) for u in unclear], "class string")).collect()}
    assert got == {(c, m): dispatch(c, m, set(targets), uses, set(declared), set(unclear)) for c, m in calls}


def test_traits_and_closures_have_no_depth(spark):
    uses = spark.createDataFrame([("C", "T1"), ("T1", "T2"), ("T2", "T3"), ("T3", "T1")], "class string, trait string")
    methods = spark.createDataFrame([("T3", "m"), ("T1", "k")], "trait string, method string")
    assert {(r["class"], r["method"]) for r in A.trait_targets(uses, methods).collect()} == {(c, m) for c in ("C", "T1", "T2", "T3") for m in ("m", "k")}
    chain = spark.range(70).selectExpr("id as src", "id + 1 as dst")
    got = G.closure(chain, spark.createDataFrame([(0,)], "node long"))
    assert got.count() == 70 and got.agg({"depth": "max"}).first()[0] == 70


def test_traits_of_cycles_are_counted_once_a_component(spark):
    rng = random.Random(4)
    nodes = 12
    edges = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(16)})
    reach = {}
    for c in {a for a, _ in edges}:
        seen, todo = set(), [c]
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x} - seen
            seen |= new
            todo += new
        reach[c] = seen
    methods = [(t, m) for t in range(0, nodes, 2) for m in ("m", "n")[: 1 + t % 4 // 2]]
    want = Counter(c for c, seen in reach.items() for t, _ in methods if t in seen)
    uses, offered = spark.createDataFrame(edges, "class long, trait long").coalesce(1), spark.createDataFrame(methods + methods[:2], "trait long, method string").coalesce(1)
    assert {(r["class"], r["targets"]) for r in A.trait_target_counts(uses, offered).collect()} == set(want.items())


def test_trait_counts_are_counts_of_target_rows(spark, monkeypatch):
    uses, methods = spark.createDataFrame([("C", "T")], "class string, trait string"), spark.createDataFrame([("T", "m")], "trait string, method string")
    rows = spark.createDataFrame([("C", "m", "T"), ("C", "n", "T"), ("D", "m", "T")], "class string, method string, trait string")
    monkeypatch.setattr(A, "trait_targets", lambda *_: rows)
    assert {tuple(r) for r in A.trait_target_counts(uses, methods).collect()} == {("C", 2), ("D", 1)}


def test_trait_targets_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(A, "CLASS_TILE", 3)
    monkeypatch.setattr(A, "METHOD_TILE", 2)
    uses = [(k, (k + 1) % 8) for k in range(8)] + [(k, 100 + k % 5) for k in range(8)] + [(None, 3), (None, 200), (50, 100), (100, 50), (60, None)]
    methods = [(t, m) for t in (0, 3, 100, 101, 102, 103, 104, 200, None) for m in ("m", "n", None)]
    got = [tuple(r) for r in A.trait_targets(spark.createDataFrame(uses, "class long, trait long").coalesce(1), spark.createDataFrame(methods * 2, "trait long, method string").coalesce(1)).collect()]
    want = set()
    for c in {a for a, _ in uses}:
        seen, todo = set(), {b for a, b in uses if a == c}
        while todo:
            x = todo.pop()
            seen.add(x)
            todo |= {b for a, b in uses if a == x and a is not None} - seen
        want |= {(c, m, t) for t, m in methods if t in seen and t is not None}
    assert len(got) == len(want) and set(got) == want
