"""Signature changes: parameters, compatible additions, value-only changes.

Built from array functions over the signature's text; a depth count keeps commas inside brackets apart. These
read text, not grammars: a default value is told by its ``=``, an optional parameter by its ``?``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _inside(signature: Column) -> Column:
    """What stands in the first pair of parentheses, null if there is none."""
    at = F.instr(signature, "(")
    rest = F.split(F.substring(signature, at + 1, F.length(signature)), "")
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("(", "<", "[", "{"), 1).when(c.isin(")", ">", "]", "}"), -1).otherwise(0)
        depth = F.when(acc["depth"] <= 0, 0).otherwise(depth)
        text = F.when(depth > 0, F.concat(acc["text"], F.when((c == ",") & (depth == 1), F.lit("\0")).otherwise(c))).otherwise(acc["text"])
        return F.struct(depth.alias("depth"), text.alias("text"))

    # an arrow's > closes nothing
    return F.when(at > 0, F.aggregate(F.transform(rest, lambda c: c), start, step)["text"])


def parameters(signature: Column) -> Column:
    """The top-level parameters, trimmed; none for empty parentheses; null without parentheses."""
    parts = F.transform(F.split(_inside(F.replace(F.replace(signature, F.lit("=>"), F.lit("\1")), F.lit("->"), F.lit("\2"))), "\0"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def arity(signature: Column) -> Column:
    return F.size(parameters(signature))


def same_arity(old: Column, new: Column) -> Column:
    """False if either cannot be counted."""
    return F.coalesce((arity(old) == arity(new)) & parameters(old).isNotNull() & parameters(new).isNotNull(), F.lit(False))


def _extends(old: Column, new: Column) -> Column:
    return (F.size(new) > F.size(old)) & (F.slice(new, 1, F.size(old)) == old)


def optional_tail(old: Column, new: Column) -> Column:
    """All old parameters come first and unchanged, and every added one may be left out."""
    a, b = parameters(old), parameters(new)
    omittable = lambda p: ~p.startswith("...") & (p.rlike(r"^[\w$]+\?") | F.contains(p, F.lit("=")))
    return F.coalesce(_extends(a, b) & F.forall(F.slice(b, F.size(a) + 1, F.greatest(F.size(b), F.lit(1))), omittable), F.lit(False))


def python_tail(old: Column, new: Column) -> Column:
    """As above for Python: only parameters with a default, or a lone star, may be added, at least one of them a
    parameter, and not behind keyword arguments."""
    a, b = parameters(old), parameters(new)
    added = F.slice(b, F.size(a) + 1, F.greatest(F.size(b), F.lit(1)))
    real = lambda p: ~p.startswith("*") & F.contains(p, F.lit("="))
    open_end = F.when(F.size(a) > 0, F.element_at(a, -1).startswith("**")).otherwise(F.lit(False))
    return F.coalesce(_extends(a, b) & ~open_end & F.forall(added, lambda p: real(p) | (p == "*")) & F.exists(added, real), F.lit(False))


SCALAR = r"^(-?\d[\w.]*|\"[^\"]*\"|'[^']*'|`[^`]*`|true|false|null|undefined)$"


def value_only(kind: Column, lang: Column, old: Column, new: Column) -> Column:
    """An immutable binding whose value alone changed: name, type and visibility are the same. In the JavaScript
    family either both have a type or both values are plain literals."""
    head = lambda s: F.trim(F.regexp_replace(F.regexp_extract(s, r"^([^=]*)=", 1), r"\s+", " "))
    value = lambda s: F.regexp_replace(F.trim(F.regexp_extract(s, r"^[^=]*=\s*(.*)$", 1)), r"\s*;?\s*$", "")
    fixed = lambda s: s.rlike(r"\b(const|static)\b") & ~s.rlike(r"\bstatic\s+mut\b|\b(let|var)\b")
    typed = F.contains(head(old), F.lit(":"))
    scalar = value(old).rlike(SCALAR) & value(new).rlike(SCALAR)
    same = fixed(old) & fixed(new) & (head(old) == head(new)) & (head(old) != "")
    return F.coalesce(kind.isin("constant", "variable") & same & ((lang == "rust") | lang.isin("typescript", "tsx", "javascript") & (typed | scalar)), F.lit(False))


def classify(kind: Column, lang: Column, old: Column, new: Column, closed: Column) -> Column:
    """The first that holds: value, compatible, closed (every caller is in the change too), modified."""
    family = lang.isin("typescript", "tsx", "javascript")
    return (
        F.when(value_only(kind, lang, old, new), "value")
        .when(family & optional_tail(old, new) | (lang == "python") & python_tail(old, new), "compatible")
        .when(F.coalesce(closed, F.lit(False)), "closed")
        .otherwise("modified")
    )
