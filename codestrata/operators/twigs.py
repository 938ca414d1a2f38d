"""Structural rules: small trees of node kinds matched against node tables.

A rule's query is a pattern such as ``(Call func: (Name) @f (#eq? @f "eval")) @call``: a node's kind (``_``: any), below it patterns of
children, each with the field that it must stand in, or ``..`` before one that may lie at any depth; ``@name`` captures a node, and
predicates compare captured names with a text (#eq?, #not-eq?) or a regular expression (#match?, #not-match?). A
match is a choice of nodes for all of the pattern's; every capture of every match is a row, as often as there are matches.

A pattern is a plan: a node table a pattern node, each filtered before it is joined; children by an equi-join over the parent's number,
descendants by a structural join of nodes sorted by number, which keeps the open ancestors on a stack and pairs only what nests.
"""

from __future__ import annotations

import ast
import dataclasses
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..config import held

MATCHES = "rule_id string, severity string, message string, path string, ln int, col int, name string, capture string"
_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<deep>\.\.)|(?P<cap>@[\w.]+)|(?P<pred>#[a-z-]+\?)|(?P<field>\w+)\s*:|(?P<kind>\w+)|"(?P<text>(?:\\.|[^"\\])*)")')


@dataclass
class Twig:
    kind: str
    field: str | None = None
    deep: bool = False
    capture: str | None = None
    below: list[Twig] = dataclasses.field(default_factory=list)
    #: (predicate, capture, text), at the root alone.
    tests: list[tuple[str, str, str]] = dataclasses.field(default_factory=list)

    def all(self) -> list[Twig]:
        return [self, *(t for b in self.below for t in b.all())]


def twig(query: str) -> Twig:
    """The pattern that a query writes. Raises ValueError where it writes none, or names kinds that no node has."""
    at, tokens = 0, []
    query = query.strip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"no pattern at {query[at : at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tests: list[tuple[str, str, str]] = []
    pos = 0

    def take(*kinds: str) -> str:
        nonlocal pos
        if pos >= len(tokens) or tokens[pos][0] not in kinds:
            raise ValueError(f"expected {' or '.join(kinds)} in {query!r}")
        pos += 1
        return tokens[pos - 1][1]

    def node(field_: str | None = None, deep: bool = False) -> Twig:
        nonlocal pos
        take("open")
        made = Twig(take("kind"), field_, deep)
        while pos < len(tokens) and tokens[pos][0] != "close":
            if tokens[pos][0] == "open" and tokens[pos + 1 : pos + 2] and tokens[pos + 1][0] == "pred":
                pos += 1
                tests.append((take("pred"), take("cap")[1:], take("text", "kind")))
                take("close")
                continue
            name = take("field") if tokens[pos][0] == "field" else None
            below = bool(tokens[pos : pos + 1]) and tokens[pos][0] == "deep"
            pos += below
            made.below.append(node(name, below))
        take("close")
        if pos < len(tokens) and tokens[pos][0] == "cap":
            made.capture = take("cap")[1:]
        return made

    root = node()
    while pos < len(tokens):  # predicates may follow the pattern
        take("open")
        tests.append((take("pred"), take("cap")[1:], take("text", "kind")))
        take("close")
    root.tests = tests
    captures = {t.capture for t in root.all()} - {None}
    for t in root.all():
        if t.kind not in ("_", "ERROR") and not (isinstance(getattr(ast, t.kind, None), type) and issubclass(getattr(ast, t.kind), ast.AST)):
            raise ValueError(f"no node is a {t.kind}")
    for pred, capture, text in tests:
        if pred not in ("#eq?", "#not-eq?", "#match?", "#not-match?") or capture not in captures:
            raise ValueError(f"no test: {pred} @{capture}")
        if "match" in pred:
            try:
                re.compile(text)
            except re.error as e:
                raise ValueError(f"no regular expression: {text!r}") from e
    return root


def nested_pairs(upper: DataFrame, lower: DataFrame, at: str, up: str) -> DataFrame:
    """Rows of ``lower`` (path, ``at``, ...), a node's number ``at``, once for each node (path, id, last) of ``upper`` above them at any
    depth, whose number is ``up``. Rows of a path are sorted by number and read once with a stack of open ancestors: time and rows grow
    with the pairs that nest."""
    rows = upper.select("path", F.col("id").alias(at), "last", F.lit(1).alias("side")).unionByName(lower.withColumns({"last": F.lit(None).cast("int"), "side": F.lit(0)}), allowMissingColumns=True)
    rows = rows.where("path is not null").repartition("path").sortWithinPartitions("path", at, "side")

    def run(batches):
        path, stack = None, []
        for b in batches:
            ups, lows = [], []
            for i, (p, n, last, side) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", at, "last", "side")), strict=True)):
                if p != path:
                    path, stack = p, []
                while stack and stack[-1][1] < n:
                    stack.pop()
                if side:
                    stack.append((n, last))
                else:
                    ups += [u for u, _ in stack]
                    lows += [i] * len(stack)
            if lows:
                own = b.select(names).take(pa.array(lows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ups, b.column(at).type)], names=[*names, up])

    names = lower.columns
    return rows.mapInArrow(run, StructType([*lower.schema.fields, StructField(up, upper.schema["id"].dataType)]))


def _test(pred: str, column: Column, text: str) -> Column:
    hit = column.rlike(text) if "match" in pred else column == text
    return F.coalesce(~hit if "not" in pred else hit, F.lit("not" in pred))


def matches(nodes_: DataFrame, pattern: Twig, about: Column | None = None) -> DataFrame:
    """(path, n0, n1 ...): the nodes of every match, numbered as ``pattern.all()`` lists its nodes; besides, a0, a1 ...: what ``about``
    says of those that are captured. A node's number is its own within its path. No side of a join is broadcast: a pattern's nodes grow with the files."""
    order = {id(t): k for k, t in enumerate(pattern.all())}
    tests: dict[str, list[tuple[str, str]]] = {}
    for pred, capture, text in pattern.tests:
        tests.setdefault(capture, []).append((pred, text))

    def candidates(t: Twig) -> DataFrame:
        """Nodes of one pattern node: its kind, field and tests leave few before anything is joined."""
        c = nodes_.where("path is not null and id is not null")
        if t.kind != "_":
            c = c.where(F.col("kind") == t.kind)
        if t.field is not None:
            c = c.where(F.col("field") == t.field)
        for pred, text in tests.get(t.capture or "", []):
            c = c.where(_test(pred, F.col("name"), text))
        k = order[id(t)]
        told = [] if about is None or t.capture is None else [about.alias(f"a{k}")]
        return c.select("path", F.col("id").alias(f"n{k}"), "last", "parent", *told)

    def solve(t: Twig) -> DataFrame:
        me, joined = f"n{order[id(t)]}", False
        out = candidates(t)
        for b in t.below:
            low, at = solve(b), f"n{order[id(b)]}"
            if b.deep:
                upper = out.select("path", F.col(me).alias("id"), "last")
                low = nested_pairs(upper.distinct() if joined else upper, low.drop("last", "parent"), at, me)
            else:
                low = low.drop("last").withColumnRenamed("parent", me).where(f"{me} is not null")
            out, joined = out.join(low.hint("merge"), ["path", me]), True
        # Two children of one node are two nodes.
        for i, x in enumerate(t.below):
            for y in t.below[i + 1 :]:
                out = out.where(F.col(f"n{order[id(x)]}") != F.col(f"n{order[id(y)]}"))
        return out

    return solve(pattern).drop("last", "parent")


def lint(nodes_: DataFrame, rules: DataFrame, language: str = "python") -> tuple[DataFrame, DataFrame]:
    """(``MATCHES``, (id, warning)) of the rules (id, language, severity, message, query, pattern) of one language on its nodes.

    A query goes before a pattern; a pattern is looked for in the names of identifiers. Rules with both or neither and queries that
    are none give warnings. Rules are written by hand and few, so the driver reads them; rules of other languages are passed over.
    The nodes are made once, whatever the number of rules.
    """
    spark = nodes_.sparkSession
    nodes_ = held(nodes_.select("path", "id", "last", "parent", "kind", "name", "field", "sl", "sc", "preview"), "nodes")
    place = [F.col("sl").alias("ln"), F.col("sc").alias("col"), F.coalesce("name", "preview").alias("name")]
    about = F.struct(*place)
    found, warned = None, []
    patterns = []
    for r in rules.where(F.col("language") == language).collect():
        if r["query"] is not None and r["pattern"] is not None:
            warned.append((r["id"], "query and pattern are mutually exclusive; using query"))
        if r["query"] is None:
            if r["pattern"] is None:
                warned.append((r["id"], "must have either query or pattern; skipped"))
            else:
                patterns.append(r["id"])
            continue
        try:
            pattern = twig(r["query"])
        except ValueError as e:
            warned.append((r["id"], f"invalid query: {e}; skipped"))
            continue
        captured = [F.struct(F.lit(t.capture).alias("capture"), F.col(f"a{k}").alias("at")) for k, t in enumerate(pattern.all()) if t.capture]
        if captured:
            rows = matches(nodes_, pattern, about).select("path", F.explode(F.array(*captured)).alias("c"))
            rows = rows.select(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(r["message"]).alias("message"), "path", "c.at.ln", "c.at.col", "c.at.name", "c.capture")
            found = rows if found is None else found.unionByName(rows)
    named = F.broadcast(rules.where(F.col("language") == language).where(F.col("id").isin(*patterns)).select(F.col("id").alias("rule_id"), "severity", "message", "pattern"))
    identifiers = nodes_.where("path is not null and id is not null and name is not null and kind in ('Name', 'Attribute', 'arg', 'keyword', 'FunctionDef', 'AsyncFunctionDef', 'ClassDef', 'alias')")
    by_name = identifiers.join(named, F.contains("name", F.col("pattern"))).select("rule_id", "severity", "message", "path", *place, F.lit(None).cast("string").alias("capture"))
    found = by_name if found is None else found.unionByName(by_name)
    return found.select(*[c.split()[0] for c in MATCHES.split(", ")]), spark.createDataFrame(warned, "id string, warning string")
