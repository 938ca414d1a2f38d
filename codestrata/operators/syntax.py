"""Syntax trees as node tables, and questions asked of them.

``nodes`` is the one step that parses (Python, by its own grammar); points, ranges, outlines, user queries, complexity
and inheritance are plans over its rows.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ensure_checkpoints
from .limits import frames
from .sweep import LINE, containers, spot

NODES = "path string, id int, last int, parent int, depth int, kind string, name string, field string, sl int, sc int, el int, ec int, preview string, error string"
PREVIEW = 256
# Nodes that make a branch.
BRANCHES = ["If", "For", "AsyncFor", "While", "ExceptHandler", "With", "AsyncWith", "Assert", "IfExp", "comprehension", "BoolOp", "match_case"]
BOUNDARIES = ["FunctionDef", "AsyncFunctionDef", "Lambda", "ClassDef"]
FUNCTIONS = ["FunctionDef", "AsyncFunctionDef"]
# Bases of unit tests.
UNITTEST_BASES = ["TestCase", "IsolatedAsyncioTestCase"]


def tree(path: str, text: str):
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        ln = max(0, (getattr(e, "lineno", None) or 1) - 1)
        yield path, 0, None, 0, "ERROR", None, None, ln, max(0, (getattr(e, "offset", None) or 1) - 1), ln, 0, None, str(getattr(e, "msg", e))
        return
    lines = text.split("\n")
    stack, n = [(root, None, 0, None)], 0
    while stack:
        node, parent, depth, field = stack.pop()
        at = parent
        if isinstance(node, ast.Module) or hasattr(node, "lineno") or isinstance(node, (ast.comprehension, ast.match_case)):
            spots = [x for x in ast.walk(node) if hasattr(x, "lineno")] if not hasattr(node, "lineno") and not isinstance(node, ast.Module) else [node]
            if isinstance(node, ast.Module):
                sl, sc, el, ec = 0, 0, len(lines) - 1, len(lines[-1].encode())
            else:
                sl, sc = min((x.lineno - 1, x.col_offset) for x in spots)
                el, ec = max((x.end_lineno - 1, x.end_col_offset) for x in spots)
            name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None)
            first = lines[sl].encode()[sc : ec if sl == el else None].decode("utf-8", "replace") if sl < len(lines) else ""
            yield path, n, parent, depth, type(node).__name__, name if isinstance(name, str) else None, field, sl, sc, el, ec, first[:PREVIEW] + ("..." if len(first) > PREVIEW else ""), None
            at, n, depth = n, n + 1, depth + 1
        children = [(c, f) for f, v in ast.iter_fields(node) for c in (v if isinstance(v, list) else [v]) if isinstance(c, ast.AST)]
        stack += [(c, at, depth, f) for c, f in reversed(children)]


def numbered(rows: list[tuple]) -> list[tuple]:
    """Nodes (path, id, parent, ...) with the last id below each as third column: what is below n are ids n + 1 to last."""
    last = [r[1] for r in rows]
    for r in reversed(rows):
        if r[2] is not None:
            last[r[2]] = max(last[r[2]], last[r[1]])
    return [(*r[:2], n, *r[2:]) for r, n in zip(rows, last, strict=True)]


def nodes(files: DataFrame) -> DataFrame:
    """``NODES`` of Python (path, lang, text) files, in order of the text; a file that doesn't parse has one ERROR."""

    def run(batches):
        for b in batches:
            found = (r for p, g, t in zip(b["path"], b["lang"], b["text"], strict=True) if g == "python" and t is not None for r in numbered([*tree(p, t)]))
            for out in frames(found, [c.split()[0] for c in NODES.split(", ")]):
                yield out.astype({"parent": "Int32"})

    return files.select("path", "lang", "text").mapInPandas(run, NODES)


def _ranges(nodes_: DataFrame, *more: Column) -> DataFrame:
    """(path, id, start, stop, up, late): nodes as ranges of places; the deepest, then the last one, ranks lowest."""
    return nodes_.select("path", "id", spot("sl", "sc").alias("start"), spot("el", "ec").alias("stop"), (-F.col("depth")).alias("up"), (-F.col("id")).alias("late"), *more)


def at_point(nodes_: DataFrame, points: DataFrame) -> DataFrame:
    """For each (path, ln, col) the deepest node that holds it. One sorted pass a path."""
    at = spot("ln", "col")
    p = points.select("path", F.lit(None).cast(nodes_.schema["id"].dataType).alias("id"), at.alias("start"), at.alias("stop"))
    hit = containers(p, _ranges(nodes_), ["path"], ["up", "late"]).where("container is not null")
    hit = hit.select("path", F.shiftright("start", 32).alias("ln"), (F.col("start") % LINE).alias("col"), F.col("container").alias("id"))
    kinds = {c: points.schema[c].dataType for c in ("ln", "col")}
    hit = hit.select("path", F.col("ln").cast(kinds["ln"]).alias("ln"), F.col("col").cast(kinds["col"]).alias("col"), "id")
    return hit.join(nodes_.select("path", "id", "kind", "name", "sl", "sc", "el", "ec"), ["path", "id"]).select("path", "ln", "col", "id", "kind", "name", "sl", "sc", "el", "ec")


def in_range(nodes_: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each (path, lo, hi) of lines the outermost nodes inside it; without any, the one at its start."""
    r = ranges.select(F.col("path").alias("rp"), "lo", "hi")
    inside = nodes_.where("parent is not null").join(r, (F.col("path") == F.col("rp")) & (F.col("sl") >= F.col("lo")) & (F.col("el") <= F.col("hi")))
    up = inside.select(F.col("path").alias("up"), F.col("id").alias("ui"), F.col("lo").alias("ul"), F.col("hi").alias("uh"))
    top = inside.join(up, (F.col("path") == F.col("up")) & (F.col("parent") == F.col("ui")) & (F.col("lo") == F.col("ul")) & (F.col("hi") == F.col("uh")), "left_anti")
    top = top.select("path", "lo", "hi", "id", "kind", "name", "sl", "sc", "el", "ec")
    none = ranges.join(top.select("path", "lo", "hi").distinct(), ["path", "lo", "hi"], "left_anti")
    back = at_point(nodes_, none.select("path", F.col("lo").alias("ln"), F.lit(0).alias("col"))).join(none, "path").where("ln = lo")
    return top.unionByName(back.select(*top.columns))


def outline(nodes_: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes down to a depth, with their beginnings."""
    return nodes_.where((F.col("depth") <= depth) & F.col("error").isNull()).select("path", "id", "parent", "depth", "kind", "name", "sl", "sc", "el", "ec", "preview")


def diagnostics(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("error is not null").select("path", F.col("sl").alias("ln"), F.col("sc").alias("col"), "error")


def query(nodes_: DataFrame, kind: str, name: str | None = None, within: str | None = None) -> DataFrame:
    """Nodes of a kind, by a regular expression over their names, inside a node of another kind at any depth."""
    if not re.fullmatch(r"[A-Za-z_]+", kind) or within is not None and not re.fullmatch(r"[A-Za-z_]+", within):
        raise ValueError("kinds are plain names")
    re.compile(name or "")
    hit = nodes_.where((F.col("kind") == kind) & (F.lit(True) if name is None else F.coalesce(F.col("name").rlike(name), F.lit(False))))
    if within is not None:
        homes = containers(_ranges(hit), _ranges(nodes_.where(F.col("kind") == within)), ["path"], ["up", "late"])
        hit = hit.join(homes.where("container is not null").select("path", "id"), ["path", "id"], "left_semi")
    return hit.select("path", "id", "kind", "name", "sl", "sc", "el", "ec", "preview")


def fallback_symbols(nodes_: DataFrame) -> DataFrame:
    """Named nodes at the top of files, for languages without symbol rules."""
    kind = F.when(F.col("kind").rlike("(?i)function"), "function").when(F.col("kind").rlike("(?i)class"), "class").otherwise("variable")
    return nodes_.where("depth = 1 and name is not null").select("path", "name", kind.alias("kind"), "sl", "el")


def complexity(nodes_: DataFrame) -> DataFrame:
    """(path, id, name, complexity) of functions: 1 and the branches whose innermost function or class it is."""
    own = containers(_ranges(nodes_.where(F.col("kind").isin(*BRANCHES))), _ranges(nodes_.where(F.col("kind").isin(*BOUNDARIES))), ["path"], ["up", "late"])
    n = own.where("container is not null").groupBy("path", F.col("container").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes_.where(F.col("kind").isin(*FUNCTIONS)).join(n, ["path", "id"], "left").select("path", "id", "name", (F.coalesce("n", F.lit(0)) + 1).alias("complexity"))


def qualified_container(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(path, id, container): the smallest outer range (path, id, sl, sc, el, ec) by lines, then columns, that holds an
    inner one; equal ranges hold nothing."""
    lines, columns = F.col("el") - F.col("sl"), F.col("ec") - F.col("sc")
    ranged = lambda df: df.select("path", "id", spot("sl", "sc").alias("start"), spot("el", "ec").alias("stop"), lines.alias("lines"), columns.alias("columns"))
    # Equal ranges hold nothing, so outer ones of one range are one, under its least id, which an inner one of that range takes too.
    first = ranged(outer).groupBy("path", "start", "stop", "lines", "columns").agg(F.min("id").alias("id"))
    asked = ranged(inner)
    places = asked.select("path", "start", "stop").distinct().join(first.select("path", "start", "stop", "id"), ["path", "start", "stop"], "left")
    found = containers(places, first, ["path"], ["lines", "columns"]).select("path", "start", "stop", "container")
    return asked.join(found, ["path", "start", "stop"], "left").select("path", "id", "container")


def test_context(nodes_: DataFrame) -> DataFrame:
    """(path, id) of nodes inside a test function or a test class."""
    marked = nodes_.where((F.col("kind").isin(*FUNCTIONS)) & F.col("name").rlike("^test_") | (F.col("kind") == "ClassDef") & F.col("name").rlike("^Test|Tests?$|TestCase$"))
    homes = containers(_ranges(nodes_), _ranges(marked), ["path"], ["up", "late"]).where("container is not null")
    return homes.select("path", "id").unionByName(marked.select("path", "id")).distinct()


def bases(nodes_: DataFrame) -> DataFrame:
    """(path, name, base) of classes."""
    c = nodes_.where("kind = 'ClassDef'").select(F.col("path").alias("cp"), F.col("id").alias("ci"), F.col("name").alias("cn"))
    b = nodes_.where("field = 'bases'").select("path", F.col("parent"), F.col("name").alias("base"))
    return c.join(b, (F.col("cp") == F.col("path")) & (F.col("ci") == F.col("parent"))).select("path", F.col("cn").alias("name"), "base")


def descendants(inherits: DataFrame, roots: DataFrame, key: str = "path") -> DataFrame:
    """(path, name) of classes that descend from (base) roots within their file, by (path, name, base) rows; each round
    adds the children of the last one's, and a table of all found is carried and cut by a checkpoint."""
    ensure_checkpoints(inherits.sparkSession)
    new = inherits.join(roots.select("base").distinct(), "base", "left_semi").select(key, "name").distinct().checkpoint()
    found = new
    while True:
        new = inherits.join(new.withColumnRenamed("name", "base"), [key, "base"], "left_semi").select(key, "name").distinct().join(found, [key, "name"], "left_anti").checkpoint()
        if not new.limit(1).count():
            return found
        found = found.unionByName(new).checkpoint()


def scope_of(uses: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, use, scope): the innermost scope (path, scope, name, lo, hi) that binds a use's (path, use, name, at)
    name; null where no scope does. One sorted pass over the uses and scopes of a path's name."""
    kind = scopes.schema["scope"].dataType
    s = scopes.select("path", "name", F.col("scope").alias("id"), F.col("lo").alias("start"), F.col("hi").alias("stop"), (F.col("hi") - F.col("lo")).alias("size"))
    places = uses.select("path", "name", F.lit(None).cast(kind).alias("id"), F.col("at").alias("start"), F.col("at").alias("stop"))
    found = containers(places, s, ["path", "name"], ["size"]).select("path", "name", F.col("start").alias("at"), F.col("container").alias("scope"))
    return uses.withColumn("at", F.col("at").cast("long")).join(found, ["path", "name", "at"], "left").select("path", "use", "scope")
