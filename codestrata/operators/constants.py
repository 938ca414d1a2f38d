"""Callers that follow a change through a constant: the call stays as it is, the object that it passes gets the new entries.

A def-use join: the argument at a call's position, the constant of its file that it names, the entries of that constant's literal. It holds only where
nothing is guessed: the argument is one bare name, no argument is spread, the name is bound once in the file and never assigned,
by ``const`` to an object literal, and every entry asked for stands in it on an added line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ensure_checkpoints
from . import blocks as B
from . import scopes as P
from . import signatures as S
from .api import key_difference, members


def added_required(old: Column, new: Column) -> Column:
    """(index, keys): the one parameter that changed, from 0, and the entries that its object type now requires too; null if anything
    else changed, or an entry that is added may be left out."""
    a, b = S.parameters(old), S.parameters(new)
    changed = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) != F.get(b, i))
    at = F.element_at(changed, 1)
    x, y = F.get(a, at), F.get(b, at)
    gone, keys, same = key_difference(members(x), members(y))
    bare = lambda p: F.regexp_replace(p, r"\{[^{}]*\}", "{}")
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.size(changed) == 1)
    plain = F.contains(x, F.lit("{")) & (bare(x) == bare(y)) & (F.size(gone) == 0) & (F.size(keys) > 0) & same & F.forall(keys, lambda k: k.rlike(r"^[A-Za-z_$][\w$]*$"))
    return F.when(fits, F.when(plain, F.struct(at.alias("index"), keys.alias("keys"))))


def followed(files: DataFrame, wanted: DataFrame, added: DataFrame) -> DataFrame:
    """(path, name, ln, col): calls of (name, index, keys) in TypeScript (path, lang, text) files whose argument at the index names a constant
    that got all the keys on ``added`` (path, line)s."""
    ensure_checkpoints(files.sparkSession)
    parts = P._parts(B.marks(files.where(F.col("lang").isin("typescript", "tsx")))).checkpoint()
    found = P.scopes(parts)
    bound = P.declarations(parts, found).checkpoint()
    w = wanted.select("name", "index", "keys").distinct()
    # Calls, and what stands in their parentheses, argument by argument.
    calls = parts.where("kind = 'id' and n1 = '('").where(~F.coalesce(F.col("p1").isin("function", "."), F.lit(False))).join(w, F.col("text") == F.col("name"))
    calls = calls.select("path", "name", "index", "keys", "ln", "col", (F.col("ord") + 1).alias("inside"))
    level = Window.partitionBy("path", "inside").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    within = parts.join(calls.select("path", "inside").distinct(), ["path", "inside"], "left_semi").withColumn("nth", F.count(F.when(F.col("text") == ",", 1)).over(level))
    spread = F.max((F.col("text") == ".") & (F.col("p1") == ".")).over(Window.partitionBy("path", "inside"))
    args = within.withColumn("spread", F.coalesce(spread, F.lit(False))).where("text <> ','").groupBy("path", "inside", "nth", "spread").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("arg"), F.min("kind").alias("kind"))
    named = calls.join(args.where("n = 1 and kind = 'id' and not spread"), ["path", "inside"]).where(F.col("nth") == F.col("index")).select("path", "name", "keys", "ln", "col", "arg")
    # Constants bound once in their file, to a literal.
    once = bound.groupBy("path", F.col("name").alias("arg")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n = 1")
    again = parts.where("kind = 'id' and n1 = '=' and (n2 is null or n2 <> '=')").groupBy("path", F.col("text").alias("arg")).agg(F.count(F.when(~F.coalesce(F.col("p1").isin("."), F.lit(False)), 1)).alias("set"))
    held = parts.where("p1 = 'const'").withColumn("lit", F.when((F.col("n1") == "=") & (F.col("n2") == "{"), F.col("ord") + 2).when((F.col("n1") == ":") & (F.col("n3") == "="), F.col("ord") + 4))
    held = held.where("lit is not null").select("path", F.col("ord").alias("at"), "lit")
    literals = parts.where("text = '{'").select("path", F.col("ord").alias("lit"))
    constants = once.join(held, ["path", "at"]).join(literals, ["path", "lit"]).join(again.where("set > 1"), ["path", "arg"], "left_anti").select("path", "arg", "lit")
    entries = parts.where("kind = 'id' and p1 in ('{', ',') and n1 in (':', ',', '}')").select("path", F.col("inside").alias("lit"), F.col("text").alias("key"), F.col("ln").alias("line"))
    fresh = entries.join(added.select("path", "line").distinct(), ["path", "line"], "left_semi").select("path", "lit", "key").distinct()
    asked = named.join(constants, ["path", "arg"]).withColumn("key", F.explode("keys"))
    met = asked.join(fresh, ["path", "lit", "key"]).groupBy("path", "name", "ln", "col", F.size("keys").alias("need")).agg(F.countDistinct("key").alias("have"))
    return met.where("have = need").select("path", "name", "ln", "col")
