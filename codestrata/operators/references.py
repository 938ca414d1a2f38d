"""Reference search over identifier tokens, lint patterns, caller routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFILTER = 32
BROADCAST_NAMES = 200_000
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def lines(files: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, ln, line) and more columns of the files: lines from 0; a carriage return before a line feed goes, a last
    empty line too."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return files.select(F.col(key).alias("key"), *more, F.posexplode(parts).alias("ln", "line"))


def tokens(files: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, ln, name) and more columns of the files: the identifiers of each line."""
    return lines(files, key, text, *more).select("key", *more, "ln", F.explode(F.regexp_extract_all("line", F.lit(f"({IDENTIFIER})"), F.lit(1))).alias("name"))


def search(files: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, ln, name, hits) for the names asked for. Texts are cut once and joined with the names, which may be many;
    a list short enough for it also leaves files without any of them out before they are cut."""
    if len(names) <= PREFILTER:
        some = F.lit(False)
        for n in names:
            some = some | F.contains(F.col(text), F.lit(n))
        files = files.where(some)
    wanted = files.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    found = tokens(files, key, text).join(F.broadcast(wanted) if len(names) <= BROADCAST_NAMES else wanted, "name", "left_semi")
    return found.groupBy("key", "ln", "name").agg(F.count(F.lit(1)).alias("hits"))


def lint(files: DataFrame, key: str, text: str, lang: str, rules: DataFrame) -> DataFrame:
    """(rule_id, severity, key, ln, name): identifiers that contain a rule's pattern, in the rule's language.

    ``rules`` (id, language, severity, pattern) come from a rule file and are broadcast.
    """
    t = tokens(files, key, text, lang)
    r = F.broadcast(rules.select(F.col("id").alias("rule_id"), "language", "severity", "pattern"))  # written by hand, a rule a row
    return t.join(r, (F.col(lang) == F.col("language")) & F.contains("name", F.col("pattern"))).select("rule_id", "severity", "key", "ln", "name")


def route(rank: dict[str, int], kind: Column) -> Column:
    """A rank for a reference kind; smaller ranks win."""
    out = F.lit(max(rank.values(), default=0) + 1)
    for name, r in rank.items():
        out = F.when(kind == name, r).otherwise(out)
    return out


def first_route(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Per key the best rank, so buckets exclude each other."""
    return rows.groupBy(*keys).agg(F.min(rank).alias("rank"))
