"""Source trees and name lists as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from . import hidden as H
from .ignores import IGNORE_FILES, ignore_rules, ignored

MOST_BYTES = 100 << 20


def read_tree(spark: SparkSession, root: str, glob: str | None = None, excluded_dirs: list[str] = (), excluded_globs: list[str] = (), exclude_generated: bool = True, most_bytes: int = MOST_BYTES, ignores: DataFrame | bool = True) -> DataFrame:
    """(path, text, length, lang, is_test) of the files under ``root`` that a scan takes.

    Paths are relative to the root. Hidden files, excluded directories and globs, files beyond ``most_bytes``,
    files that aren't UTF-8, of no known language, or generated are left out; path rules are applied to the
    file listing's columns, before contents are decoded. The rules of the tree's ignore files hide paths too; ``ignores`` may give such
    files as (path, text) instead, or False for none. What Spark's listing leaves out, names that begin with an underscore and
    the ignore files, is listed and read in tasks (``hidden``).
    """
    base = root.rstrip("/")
    rel = F.substring_index(F.col("path"), base.split(":", 1)[-1].lstrip("/") + "/", -1)
    shown = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).withColumn("rel", rel).select("rel", "length", "content")
    every = H.listing(spark, base).where(F.col("rel").rlike(r"(^|/)[_.]"))
    seen = ~F.exists(F.split("rel", "/"), lambda s: s.startswith("."))
    passed_over = every.where(seen & (F.col("length") <= most_bytes)).join(shown.select("rel"), "rel", "left_anti")
    if ignores is True:
        rules = every.where(F.element_at(F.split("rel", "/"), -1).isin(IGNORE_FILES))
        ignores = H.contents(rules, base).select(F.col("rel").alias("path"), F.col("content").cast("string").alias("text"))
    files = shown.where((F.col("length") <= most_bytes) & seen).unionByName(H.contents(passed_over, base))
    if excluded_dirs:
        files = files.where(~F.arrays_overlap(F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1), F.array(*map(F.lit, excluded_dirs))))
    if excluded_globs:
        files = files.where(~P.matches_glob(F.col("rel"), list(excluded_globs)))
    if glob:
        files = files.where(P.matches_glob(F.col("rel"), [glob]))
    if ignores is not False:
        hidden = ignored(files.select(F.col("rel").alias("path")), ignore_rules(ignores)).where("ignored").select(F.col("path").alias("rel"))
        files = files.join(hidden, "rel", "left_anti")
    text = files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("rel").alias("path"), F.col("content").cast("string").alias("text"), "length")
    head = F.substring("text", 1, P.HEAD_BYTES)
    kept = text.where(P.keep_candidate(F.col("path"), head, exclude_generated))
    lang = P.language(F.col("path"), F.element_at(F.split(head, "\n"), 1))
    return kept.withColumn("lang", P.header_language(F.col("path"), lang, F.col("text"))).withColumn("is_test", P.is_test_path(F.col("path")))


def merged(scan: DataFrame, extra: DataFrame) -> DataFrame:
    """A scan and explicit files, each path once, however it is written; what the scan gave stands before the others."""
    from ..operators.lexing import resolved

    both = scan.withColumn("later", F.lit(False)).unionByName(extra.withColumn("later", F.lit(True))).withColumn("canonical", F.coalesce(resolved(F.col("path")), F.col("path")))
    names = [c for c in scan.columns if c != "path"]
    best = both.groupBy("canonical").agg(F.min_by(F.struct("path", *names), F.struct("later", "path")).alias("row"))
    return best.select(*[F.col(f"row.{c}").alias(c) for c in scan.columns])


def names(spark: SparkSession, name: str | None = None, many: str | None = None) -> DataFrame:
    """(ord, name) of one name or a comma list; exactly one of them."""
    if (name is None) == (many is None):
        raise ValueError("give either one name or a list")
    parts = [p.strip() for p in (many.split(",") if many is not None else [name])]
    parts = [p for p in parts if p]
    if not parts:
        raise ValueError("no name")
    return spark.createDataFrame([*enumerate(parts)], "ord int, name string")
