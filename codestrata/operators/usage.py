"""Usage-log metrics over one fact table, and interaction segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shell_category(command: str = "command") -> Column:
    """The program a shell line runs: settings before it and its directory are dropped, only the first segment of
    a chain counts; (empty) for a line without one."""
    bare = F.regexp_replace(F.trim(F.col(command)), r"^(?:[^\s=]\S*=\S*(?:\s+|$))+", "")
    first = F.trim(F.element_at(F.split(bare, r"&&|\|\||;"), 1))
    name = F.element_at(F.split(F.element_at(F.split(first, r"\s+"), 1), "/"), -1)
    return F.when(F.col(command).isNotNull(), F.coalesce(F.nullif(name, F.lit("")), F.lit("(empty)")))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def counts(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"))


def with_share(df: DataFrame, within: list[str], count: str = "calls", digits: int = 1) -> DataFrame:
    """Adds the percentage of each group's total."""
    total = F.sum(count).over(Window.partitionBy(*within))
    return df.withColumn("pct", F.round(F.col(count) * 100.0 / total, digits))


def grouping_sets(calls: DataFrame, source: str, project: str, tool: str) -> DataFrame:
    """Counts by source, by source and tool, and by source, project and tool, from one pass."""
    out = calls.groupingSets([[F.col(source)], [F.col(source), F.col(tool)], [F.col(source), F.col(project), F.col(tool)]], source, project, tool)
    return out.agg(F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("level"))


def recent(daily: DataFrame, day: str, n: int) -> DataFrame:
    """The last n days that occur, oldest first, with a bar scaled to the largest count.

    Days are a small dimension; the top n are taken before anything is compared with all of them.
    """
    last = daily.orderBy(F.desc(day)).limit(n)
    most = last.agg(F.max("calls").alias("most"))
    bar = F.repeat(F.lit("█"), F.floor(F.col("calls") * 30 / F.col("most")).cast("int"))
    return last.crossJoin(F.broadcast(most)).withColumn("bar", bar).drop("most")


def top_nested(calls: DataFrame, outer: str, inner: str, n_outer: int, n_inner: int) -> DataFrame:
    """The n_outer busiest groups, and of each its n_inner busiest members; ties by name."""
    by_outer = counts(calls, [outer]).orderBy(F.desc("calls"), outer).limit(n_outer).withColumnRenamed("calls", "outer_calls")
    pairs = counts(calls, [outer, inner]).join(F.broadcast(by_outer), outer)  # n_outer rows
    nth = F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("calls"), inner))
    return pairs.withColumn("rank", nth).where(F.col("rank") <= n_inner)


def interactions(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """One row an interaction: a user turn and what follows up to the next one."""
    turn = F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumn("interaction", turn).where("interaction > 0")
    return rows.groupBy(session, "interaction").agg(
        F.min(order).alias("first_turn"), F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col(role) != "user", 1)).alias("replies"),
        F.sum(F.length(text)).alias("chars"), F.max(F.when(F.col(role) == "user", F.col(text))).alias("prompt"),
    ).where(F.length("prompt") > 0)


def call_edges(turns: DataFrame, session: str, order: str, role: str) -> DataFrame:
    """(session, seq, caller, callee): each turn hands over to the next."""
    w = Window.partitionBy(session).orderBy(order)
    return turns.select(session, F.col(order).alias("seq"), F.col(role).alias("caller"), F.lead(role).over(w).alias("callee")).where("callee is not null")


def call_groups(edges: DataFrame) -> DataFrame:
    """Edges grouped by caller and callee, with the first place each was seen."""
    return edges.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"), F.min("seq").alias("first_seq"))
