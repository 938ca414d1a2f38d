"""Containment and overlap of ranges within a path. All joins carry the path as an equi-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweep import containers


def innermost(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Each inner range (path, id, lo, hi) with the smallest outer range that contains it, null if none.

    Fewest lines first, then the smaller id. A range does not contain itself (the same id). One sorted pass over
    the ranges of a path, however deep they nest.
    """
    a = inner.select("path", "id", F.col("lo").alias("start"), F.col("hi").alias("stop"))
    o = outer.select("path", "id", F.col("lo").alias("start"), F.col("hi").alias("stop"), (F.col("hi") - F.col("lo")).alias("container_height"))
    kind = {c: inner.schema[c].dataType for c in ("lo", "hi")}
    found = containers(a, o, ["path"], ["container_height"])
    return found.select("path", "id", F.col("start").cast(kind["lo"]).alias("lo"), F.col("stop").cast(kind["hi"]).alias("hi"), "container", F.col("container_height").cast(kind["hi"]).alias("container_height"))


def hunk_overlaps(sl: Column, el: Column, start: Column, count: Column) -> Column:
    """Symbol lines sl..el (0-based, inclusive) against a new-side hunk (1-based start, count lines).

    A hunk without new lines lies between lines: it touches a symbol that starts at or before it and ends
    after it.
    """
    hs = F.greatest(start - 1, F.lit(0))
    return F.when(count == 0, (sl <= hs) & (hs < el)).otherwise((hs <= el) & (hs + count > sl))


def affected(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols (path, id, sl, el) with the first hunk (path, hunk, new_start, new_count) that overlaps them."""
    h = hunks.select(F.col("path").alias("hp"), "hunk", "old_count", "new_start", "new_count", "added_in_hunk")
    on = (symbols["path"] == h["hp"]) & hunk_overlaps(symbols["sl"], symbols["el"], h["new_start"], h["new_count"])
    first = symbols.join(h, on).withColumn("nth", F.row_number().over(Window.partitionBy("path", "id").orderBy("hunk"))).where("nth = 1")
    hs, n = F.greatest(F.col("new_start") - 1, F.lit(0)), F.col("new_count")
    covered = (hs <= F.col("sl")) & (hs + n > F.col("el"))
    change = (
        F.when(n == 0, "removed")
        .when(covered & (F.col("old_count") + F.col("added_in_hunk") == n), "added")
        .when(F.col("old_count") == 0, F.when(covered, "added").otherwise("modified"))
        .otherwise("modified")
    )
    return first.withColumn("change", change).drop("hp", "nth")


def touched(symbols: DataFrame, added: DataFrame) -> DataFrame:
    """Symbols with an added line (path, line) in their range."""
    a = added.select(F.col("path").alias("ap"), F.col("line").alias("al"))
    return symbols.join(a, (symbols["path"] == a["ap"]) & (a["al"] >= symbols["sl"]) & (a["al"] <= symbols["el"]), "left_semi")


def snippet(lines: DataFrame, at: DataFrame, around: int = 3) -> DataFrame:
    """(key, at, snippet): lines (key, ln, text), ln from 0, around places (key, at), numbered from 1, the
    place itself marked."""
    a = at.select(F.col("key").alias("ak"), F.col("at"))
    near = lines.join(a, (lines["key"] == a["ak"]) & (lines["ln"] >= a["at"] - around) & (lines["ln"] <= a["at"] + around))
    width = F.length((F.col("at") + around + 1).cast("string"))
    mark = F.when(F.col("ln") == F.col("at"), F.lit("> ")).otherwise(F.lit("  "))
    text = F.concat(mark, F.lpad((F.col("ln") + 1).cast("string"), width, " "), F.lit(" | "), F.col("text"))
    parts = near.select("key", "at", F.struct("ln", text.alias("t")).alias("s")).groupBy("key", "at").agg(F.array_sort(F.collect_list("s")).alias("all"))
    return parts.select("key", "at", F.array_join(F.transform("all", lambda s: s["t"]), "\n").alias("snippet"))
