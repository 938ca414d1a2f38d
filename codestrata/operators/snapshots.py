"""Snapshot differences of public interfaces, moves, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change, old_signature, new_signature) of (name, signature) snapshots.

    A name that is on a side more than once is never called modified.
    """
    side = lambda df, c: df.groupBy("name").agg(F.count(F.lit(1)).alias(f"n_{c}"), F.min("signature").alias(f"{c}_signature"))
    both = side(old, "old").join(side(new, "new"), "name", "full_outer")
    change = (
        F.when(F.col("n_old").isNull(), "added")
        .when(F.col("n_new").isNull(), "removed")
        .when((F.col("n_old") == 1) & (F.col("n_new") == 1) & ~F.col("old_signature").eqNullSafe(F.col("new_signature")), "modified")
    )
    return both.withColumn("change", change).where("change is not null").select("name", "change", "old_signature", "new_signature")


def moves(removed: DataFrame, added: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moved, still removed, still added): the k-th removal of a key pairs with its k-th addition.

    ``order`` columns fix which comes first. Nulls in a key are one value.
    """
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    r, a = removed.withColumn("nth", nth), added.withColumn("nth", nth)
    on = (F.col("r.nth") == F.col("a.nth"))
    for k in key:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}"))
    moved = r.alias("r").join(a.alias("a"), on).select(*[F.col(f"r.{k}").alias(k) for k in key], *[c for o in order for c in (F.col(f"r.{o}").alias(f"from_{o}"), F.col(f"a.{o}").alias(f"to_{o}"))])
    left = r.alias("r").join(a.alias("a"), on, "left_anti").drop("nth")
    new = a.alias("a").join(r.alias("r"), on, "left_anti").drop("nth")
    return moved, left, new


def mutual_unique(deleted: DataFrame, untracked: DataFrame, ratio: int = 2) -> DataFrame:
    """Rename pairs (deleted_id, untracked_id) of (id, lang, size, exports) rows: same language and exports,
    sizes within ``ratio``, and neither side with another partner.

    Pairs are not formed to be counted. In a group of one language and export set whose sizes all lie within
    the ratio, every two sides are partners, so it has a pair only if each side has one member; that is
    decided from counts. Only groups of wider sizes are joined.
    """
    side = lambda df, d: df.select("id", "lang", "size", "exports", F.lit(d).alias("deleted"))
    rows = side(deleted, True).unionByName(side(untracked, False))
    g = Window.partitionBy("lang", "exports")
    n = lambda d: F.count(F.when(F.col("deleted") == d, 1))
    groups = rows.groupBy("lang", "exports").agg(
        n(True).alias("nd"), n(False).alias("nu"), F.min("size").alias("low"), F.max("size").alias("high"),
        F.min(F.when(F.col("deleted"), F.col("id"))).alias("deleted_id"), F.min(F.when(~F.col("deleted"), F.col("id"))).alias("untracked_id"),
    ).where("nd > 0 and nu > 0")
    close = F.col("high") <= ratio * F.col("low")
    easy = groups.where(close & (F.col("nd") == 1) & (F.col("nu") == 1)).select("deleted_id", "untracked_id")
    wide = rows.join(groups.where(~close).select("lang", "exports"), ["lang", "exports"], "left_semi")
    d, u = wide.where("deleted").alias("d"), wide.where("not deleted").alias("u")
    edges = d.join(
        u, (F.col("d.lang") == F.col("u.lang")) & (F.col("d.exports") == F.col("u.exports")) & (F.greatest("d.size", "u.size") <= ratio * F.least("d.size", "u.size"))
    ).select(F.col("d.id").alias("deleted_id"), F.col("u.id").alias("untracked_id"))
    deg = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    hard = edges.withColumn("a", deg("deleted_id")).withColumn("b", deg("untracked_id")).where("a = 1 and b = 1").drop("a", "b")
    return easy.unionByName(hard)
