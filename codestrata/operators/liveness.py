"""Dead-symbol classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reference_counts(references: DataFrame) -> DataFrame:
    """(key, prod, test) from (key, is_test) reference rows that are no definitions."""
    return references.groupBy("key").agg(F.count(F.when(~F.col("is_test"), 1)).alias("prod"), F.count(F.when(F.col("is_test"), 1)).alias("test"))


def with_aliases(counts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Counts of a key plus those of its aliases (key, alias)."""
    more = aliases.join(counts, aliases["alias"] == counts["key"]).select(aliases["key"], "prod", "test")
    return counts.unionByName(more).groupBy("key").agg(F.sum("prod").alias("prod"), F.sum("test").alias("test"))


def classify(candidates: DataFrame, counts: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Candidates (name, key, ...) with prod, test and status.

    duplicate: the key has several candidates, so its references cannot be told apart; live: referenced
    outside tests, or by an asset; test-only; dead.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    rows = candidates.withColumn("key_count", n).join(counts, "key", "left")
    rows = rows.withColumn("prod", F.coalesce("prod", F.lit(0))).withColumn("test", F.coalesce("test", F.lit(0)))
    if assets is not None:
        rows = rows.join(assets.select("key", F.lit(True).alias("asset")).distinct(), "key", "left")
    else:
        rows = rows.withColumn("asset", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("key_count") > 1, "duplicate")
        .when((F.col("prod") > 0) | F.coalesce("asset", F.lit(False)), "live")
        .when(F.col("test") > 0, "test-only")
        .otherwise("dead")
    )
    return rows.withColumn("status", status).drop("asset")


def touched(dead: DataFrame, added_lines: DataFrame) -> DataFrame:
    """Of dead (file, line, ...) those declared on an added (file, line); unknown lines stay."""
    hits = added_lines.select(F.col("file").alias("f"), F.col("line").alias("l"), F.lit(True).alias("hit")).distinct()
    return dead.join(hits, (dead["file"] == F.col("f")) & (dead["line"] == F.col("l")), "left").where(F.col("hit").isNotNull() | F.col("line").isNull()).drop("f", "l", "hit")


def without_added(dead: DataFrame, added: DataFrame) -> DataFrame:
    """Dead symbols that the change itself adds are work in progress."""
    return dead.join(added.select("file", "name").distinct(), ["file", "name"], "left_anti")
