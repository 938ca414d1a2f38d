"""Co-change: which files change together with a source file, over its evidence commits.

Input tables: evidence(source, sha, author_mail, author_time), commit_files(sha, path). The self-join of a
commit's files is an equi-join on the commit, and commits above ``max_files_per_commit`` weigh nothing and go
before the join, so a commit makes at most that many squared pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CoChangeConfig
from .dealing import deal


def weight(n_files: Column, config: CoChangeConfig) -> Column:
    """1 up to the pivot, then falling with the root of the size, 0 above the hard cap."""
    soft = F.least(F.lit(1.0), F.sqrt(F.lit(float(config.pivot)) / F.greatest(n_files, F.lit(1))))
    return F.when(n_files > config.max_files_per_commit, F.lit(0.0)).otherwise(soft)


def author_unit(mail: Column, time: Column, config: CoChangeConfig) -> Column:
    """An author's commits within one window are one unit of knowledge."""
    return F.struct(mail.alias("mail"), F.floor(time / F.lit(86400 * config.author_window_days)).alias("span"))


def candidates(evidence: DataFrame, commit_files: DataFrame, config: CoChangeConfig, exclude_all_sources: bool = True, parts: int | None = None) -> DataFrame:
    """One row a (source, candidate): co, den, units, weights, confidence, score.

    What is counted once a commit is told apart where the commit is, in ``parts`` dealt by commit; what is counted once a unit where
    the unit is, dealt by unit with a row a commit. Only counts of pairs are shuffled, never a pair a commit."""
    files = deal(commit_files.select("sha", "path"), parts, "sha").distinct()
    sizes = files.groupBy("sha").agg(F.count(F.lit(1)).alias("n_files"))
    told = deal(evidence.select("source", "sha", "author_mail", "author_time"), parts, "sha").distinct()
    # a commit without a readable file list still counts, with weight 1
    used = told.join(sizes, "sha", "left")
    used = used.withColumn("w", weight(F.coalesce("n_files", F.lit(0)), config)).where("w > 0")
    known = F.col("author_mail").isNotNull() & F.col("author_time").isNotNull()
    active = config.author_window_days > 0
    used = used.withColumn("unit", F.when(known, author_unit(F.col("author_mail"), F.col("author_time"), config)) if active else F.lit(None).cast("string"))
    in_unit = deal(used.where("unit is not null").select("source", "unit"), parts, "unit").distinct().groupBy("source").agg(F.count("unit").alias("units"))
    in_commit = used.groupBy("sha", "source").agg(F.sum("w").alias("w")).groupBy("source").agg(F.count("sha").alias("den"), F.sum("w").alias("sum_w"))
    per_source = in_commit.join(in_unit, "source", "left").withColumn("units", F.coalesce("units", F.lit(0)))
    pairs = used.select("source", "sha", "w").join(files, "sha").where(F.col("path") != F.col("source")).groupBy("sha", "source", F.col("path").alias("candidate")).agg(F.sum("w").alias("w"))
    per_pair = pairs.groupBy("source", "candidate").agg(F.count("sha").alias("co"), F.sum("w").alias("co_w"))
    lists = files.join(sizes.where(F.col("n_files") <= config.max_files_per_commit), "sha", "left_semi").groupBy("sha").agg(F.collect_list("path").alias("paths"))
    held = used.where("unit is not null").groupBy("sha", "unit").agg(F.collect_set("source").alias("sources")).join(lists, "sha")
    apart = deal(held.select("unit", "sources", "paths"), parts, "unit").select("unit", F.explode("sources").alias("source"), "paths").select("unit", "source", F.explode("paths").alias("candidate"))
    together = apart.where("candidate <> source").distinct().groupBy("source", "candidate").agg(F.count(F.lit(1)).alias("co_units"))
    per_pair = per_pair.join(together, ["source", "candidate"], "left").withColumn("co_units", F.coalesce("co_units", F.lit(0)))
    if exclude_all_sources:
        per_pair = per_pair.join(evidence.select(F.col("source").alias("candidate")).distinct(), "candidate", "left_anti")
    per_candidate = files.groupBy(F.col("path").alias("candidate")).agg(F.count(F.lit(1)).alias("total_changes_b"))
    evidence_size = told.select("sha", "source").distinct().groupBy("source").agg(F.count("sha").alias("total_changes_a"))
    joined = per_pair.join(per_source, "source").join(evidence_size, "source").join(per_candidate, "candidate")
    confidence = F.col("co") / F.col("den")
    a, b = F.lit(config.alpha), F.lit(config.beta)
    by_units = (F.col("co_units") + a) / (F.col("units") + a + b)
    by_weight = (F.col("co_w") + a) / (F.col("sum_w") + a + b)
    smooth = F.when(F.col("units") > 0, by_units).otherwise(by_weight) if config.author_window_days > 0 else by_weight
    return joined.withColumn("confidence", confidence).withColumn("score", smooth if config.smoothing else confidence)


def stage(config: CoChangeConfig) -> Column:
    """The first threshold a candidate fails, null if none."""
    return (
        F.when((F.col("co") < config.min_samples) | (F.col("den") < config.min_denominator), F.lit("samples"))
        .when(F.col("confidence") < config.min_confidence, F.lit("confidence"))
        .when(F.col("score") < config.min_score, F.lit("score"))
    )


def ranked(found: DataFrame, config: CoChangeConfig) -> DataFrame:
    """Candidates that pass, the best of each source, in the total order."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), F.desc("co"), F.desc("confidence"), "candidate")
    passed = found.where(stage(config).isNull()).withColumn("rank", F.row_number().over(order))
    return passed.where(F.col("rank") <= config.per_source_limit)


def diagnostics(found: DataFrame, config: CoChangeConfig) -> DataFrame:
    """How many candidates fail at each stage, and how many pass and are cut."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), F.desc("co"), F.desc("confidence"), "candidate")
    staged = found.withColumn("stage", stage(config))
    staged = staged.withColumn("rank", F.when(F.col("stage").isNull(), F.row_number().over(Window.partitionBy("source", F.col("stage").isNull()).orderBy(*[F.desc("score"), F.desc("co"), F.desc("confidence"), "candidate"]))))
    return staged.agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count(F.when(F.col("stage") == s, 1)).alias(f"failed_{s}") for s in ("samples", "confidence", "score")],
        F.count(F.when(F.col("stage").isNull() & (F.col("rank") <= config.per_source_limit), 1)).alias("returned"),
        F.count(F.when(F.col("rank") > config.per_source_limit, 1)).alias("truncated"),
    )


def history(touches: DataFrame, limit: int, parts: int | None = None) -> DataFrame:
    """The last ``limit`` commits of each path: (path, sha, ord) in commit order; ``parts`` dealt by path."""
    order = Window.partitionBy("path").orderBy(F.desc("ord"), F.desc("sha"))
    return deal(touches.select("path", "sha", "ord"), parts, "path").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def choose_evidence(blame: DataFrame, past: DataFrame, min_denominator: int, parts: int | None = None) -> DataFrame:
    """Per source the blame commits, or the history where blame has too few and history has more.

    Both inputs are (source, sha); the result adds ``mode``. All is done in ``parts`` dealt by source.
    """
    both = blame.select("source", "sha", F.lit("blame").alias("mode")).unionByName(past.select("source", "sha", F.lit("history").alias("mode")))
    both = deal(both.where("source is not null"), parts, "source").distinct()
    n = lambda mode: F.count(F.when(F.col("mode") == mode, F.col("sha"))).alias(f"n_{mode}")
    sizes = both.groupBy("source").agg(n("blame"), n("history"))
    chosen = F.when((F.col("n_blame") < min_denominator) & (F.col("n_history") > F.col("n_blame")), "history").otherwise("blame")
    return both.join(sizes.select("source", chosen.alias("chosen")), "source").where("mode = chosen").select("source", "mode", "sha")


def missing(pairs: DataFrame, changed: DataFrame, limit: int = 10, lock_pairs: DataFrame | None = None) -> DataFrame:
    """Files that usually change with a changed one but did not: (file, expected_with, confidence).

    ``pairs``: (source, candidate, confidence); ``changed``: (path). Exactly one side may be changed. Per file
    the most confident partner stays, the first by name on a tie.
    """
    mark = lambda name: changed.select(F.col("path").alias(name), F.lit(True).alias(f"in_{name}")).distinct()
    sided = pairs.join(mark("source"), "source", "left").join(mark("candidate"), "candidate", "left")
    a, b = F.coalesce("in_source", F.lit(False)), F.coalesce("in_candidate", F.lit(False))
    one = sided.where(a != b).select(F.when(a, F.col("candidate")).otherwise(F.col("source")).alias("file"), F.when(a, F.col("source")).otherwise(F.col("candidate")).alias("expected_with"), "confidence")
    if lock_pairs is not None:
        one = one.join(lock_pairs.select(F.col("a").alias("file"), F.col("b").alias("expected_with")).unionByName(lock_pairs.select(F.col("b").alias("file"), F.col("a").alias("expected_with"))), ["file", "expected_with"], "left_anti")
    best = Window.partitionBy("file").orderBy(F.desc("confidence"), "expected_with")
    top = one.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    return top.orderBy(F.desc("confidence"), "file", "expected_with").limit(limit)
