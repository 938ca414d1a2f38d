"""Reviews of a change to a source tree that the parts make.

Each part is a Python function that calls the part of half its number, four numbers share a file. By size: up to 10 removed, to 15 a
parameter with a default more, to 20 a parameter more, to 25 moved to another folder, to 30 test code, from 46 on added, others as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ensure_checkpoints
from ..operators import review as W
from ..sources import diffs as D
from .history import read
from .registry import query

TREE_SQL = """
    WITH p AS (SELECT p_partkey AS k, p_size AS s, 'p_' || p_partkey AS name, (p_partkey // 4) || '.py' AS base FROM part),
    o AS (SELECT k, s, name, CASE WHEN s BETWEEN 26 AND 30 THEN 'tests/t' ELSE 'pkg/f' END || base AS path, 'def ' || name || '(a, b):' AS signature FROM p WHERE s < 46),
    n AS (SELECT k, s, name, CASE WHEN s BETWEEN 26 AND 30 THEN 'tests/t' WHEN s BETWEEN 21 AND 25 THEN 'moved/f' ELSE 'pkg/f' END || base AS path,
                 'def ' || name || CASE WHEN s BETWEEN 11 AND 15 THEN '(a, b, c=None):' WHEN s BETWEEN 16 AND 20 THEN '(a, b, c):' ELSE '(a, b):' END AS signature FROM p WHERE s > 10),
    uses AS (SELECT k // 2 AS k, bool_or(s NOT BETWEEN 26 AND 30) AS by_code FROM n GROUP BY 1)
"""


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) files (path, lang, text)."""
    k, s = F.col("p_partkey"), F.col("p_size")
    parts = read(spark, sf_dir, "part").select(k.alias("k"), s.alias("s"), F.expr("p_partkey div 4").cast("string").alias("base"), F.expr("p_partkey div 2").cast("string").alias("half"))
    old_folder = F.when(F.col("s").between(26, 30), "tests/t").otherwise("pkg/f")
    new_folder = F.when(F.col("s").between(21, 25), "moved/f").otherwise(old_folder)
    more = F.when(F.col("s").between(11, 15), ", c=None").when(F.col("s").between(16, 20), ", c").otherwise("")

    def files(rows: DataFrame, folder: Column, last: Column) -> DataFrame:
        text = F.concat(F.lit("def p_"), F.col("k").cast("string"), F.lit("(a, b"), last, F.lit("):\n    return p_"), F.col("half"), F.lit("(a, b)\n\n\n"))
        each = rows.select(F.concat(folder, "base", F.lit(".py")).alias("path"), F.struct(F.col("k"), text.alias("t")).alias("x"))
        return each.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("text")).select("path", F.lit("python").alias("lang"), "text")

    return files(parts.where("s < 46"), old_folder, F.lit("")), files(parts.where("s > 10"), new_folder, more)


@query("review_interface", TREE_SQL + """
    SELECT coalesce(o.name, n.name) AS name, coalesce(o.path, n.path) AS file,
           CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.path <> n.path THEN 'moved' ELSE 'modified' END AS change,
           o.signature AS old_signature, CASE WHEN o.path = n.path OR o.k IS NULL THEN n.signature END AS new_signature,
           CASE WHEN o.path = n.path AND n.s <= 15 THEN 'python-tail' WHEN o.path = n.path THEN 'modified' END AS verdict,
           CASE WHEN n.k IS NULL THEN CASE WHEN u.k IS NOT NULL THEN 'kept' ELSE 'dead' END END AS fate,
           CASE WHEN o.path <> n.path THEN n.path END AS to_file
    FROM o FULL JOIN n ON o.k = n.k LEFT JOIN uses u ON u.k = o.k
    WHERE coalesce(o.s, n.s) NOT BETWEEN 26 AND 45
""")
def review_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the exported surface moves, with what becomes of removed names."""
    ensure_checkpoints(spark)
    old, new = (t.checkpoint() for t in trees(spark, sf_dir))
    return W.interface(old, new, new)


@query("review_dead", TREE_SQL + """
    SELECT n.path, n.name, CASE WHEN u.k IS NULL THEN 'dead' ELSE 'test-only' END AS status
    FROM n LEFT JOIN uses u ON u.k = n.k WHERE n.s NOT BETWEEN 26 AND 30 AND NOT coalesce(u.by_code, false)
""")
def review_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new tree as one change that adds every line: functions that nothing calls, or tests alone."""
    ensure_checkpoints(spark)
    _, new = trees(spark, sf_dir)
    new = new.checkpoint()
    lines = D.parse(D.all_added(new)).checkpoint()
    return W.dead(new, lines).select("path", "name", "status")
