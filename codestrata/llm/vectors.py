"""What both vector searches need: valid vectors, a bounded sample, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest


def valid(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part.

    Out go null ids, null or empty vectors, vectors with a null or non-finite component, with ``nonzero``
    zero vectors, and vectors whose dimension is not the commonest one (on a tie the smaller dimension),
    between which no product is defined.
    """
    big = F.lit(float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    )
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.where(F.size("v") == (dims[0]["dim"] if dims else 0))


def sample(rows: DataFrame, n: int, most_bytes: int = 32 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of the ``n`` rows that hash lowest, fewer for very wide vectors, each id once: a
    bounded sample that is the same at every run."""
    first = rows.select(F.size("v")).take(1)
    if not first:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    n = max(1, min(n, most_bytes // (8 * first[0][0])))
    got = lowest(rows, F.xxhash64("vec_id"), n, rows.count()).collect() or rows.limit(n).collect()  # ids that repeat may all hash high
    once = {r["vec_id"]: r["v"] for r in reversed(got)}
    ids = np.array(list(once)[::-1], np.int64)
    return ids, np.array(list(once.values())[::-1], np.float64)


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def lists(m: np.ndarray) -> pa.ListArray:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d or 1, dtype=np.int32)[: n + 1]), pa.array(m.reshape(-1)))


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of (query_id, vec_id, score), ties to the smaller vec_id.
    An id met twice, in two trees or on repeated rows, counts once with its best score. Per query there are
    at most k rows from each place searched."""
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row of scores, ties to the smaller id; scores of -inf never."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        cut = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= cut]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def unit(*cols: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")
