"""Exact top-k by inner product: a Voronoi kNN join.

Pivots split the data into groups. Of each group only a summary is kept on the driver: rows and the radius
(largest distance to its pivot). For a query q the group of pivot p and radius R cannot hold a score above
q.p + |q| R, so q is sent only to groups where that bound reaches the k-th best score among a bounded sample
of witnesses, which is a true lower bound of its k-th best score. Groups are cut into blocks of a bounded
number of rows (a hot group becomes many blocks), queries into blocks likewise; each pair of blocks is solved
on its own, and returns only scores at or above the witness bound.

The pivots and witnesses decide what is skipped, never what is right. On data without clusters the bounds
skip nothing and every query meets every row, in blocks; that is what exactness costs there.

Dirty input. See ``vectors.valid`` for rows that take no part. A vec_id on several rows counts once in a
result, with its best score, and never as a partner of itself. Ties go to the smaller vec_id. An empty
table, or queries without any candidate, give no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import best, lists, matrix, sample, top_rows, unit, valid

K = 5
EVERY = 50
SCALE = 256
PIVOTS = 64
WITNESSES = 4096
BLOCK_ROWS = 65536
QUERY_ROWS = 65536
#: Score cells computed at once in a task.
CELLS = 2 << 20


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Components as floor(scale * x), still doubles: integers, exact below 2^53."""
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: single precision while every partial sum stays below 2^24, double below
    2^53, else Python integers, held within a signed 64-bit long."""
    most = max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(x).max(initial=0))) * max(1, q.shape[1])
    if most < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    wide = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    out = wide(q).dot(wide(x).T)
    return np.clip(out, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _assign(pivots: np.ndarray):
    def run(batches):
        half = (pivots * pivots).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            g = (half - 2 * (x @ pivots.T)).argmin(1)
            dist = np.sqrt(((x - pivots[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(g.astype(np.int32)), pa.array(dist)], names=["vec_id", "v", "g", "dist"])

    return run


def _bound(ids: np.ndarray, witnesses: np.ndarray, pivots: np.ndarray, radius: np.ndarray, k: int):
    """Per query: the lower bound of its k-th score, and the groups that may reach it."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, own = matrix(b.column("v")), b.column("vec_id").to_numpy()
            s = products(q, witnesses).astype(np.float64)
            s[own[:, None] == ids[None, :]] = -np.inf
            theta = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(q), -np.inf)
            reach = q @ pivots.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
            slack = 1e-9 * (1 + np.abs(reach))  # rounding of the bound must not skip a tie
            rows, groups = np.nonzero((reach + slack >= theta[:, None]) & (radius >= 0)[None, :])
            low = np.where(np.isfinite(theta), np.maximum(theta, -(2.0**62)), -(2.0**62)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[rows]), b.column("v").take(pa.array(rows)), pa.array(low[rows]), pa.array(groups.astype(np.int32))], names=["query_id", "q", "low", "g"]
            )

    return run


def _solve(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if data.num_rows and queries.num_rows:
            key = lambda t: t.column("g").to_numpy().astype(np.int64) << 32 | t.column("block").to_numpy()
            dk, qk = key(data), key(queries)
            ids, x = data.column("vec_id").to_numpy(), matrix(data.column("v"))
            qids, low, q = queries.column("query_id").to_numpy(), queries.column("low").to_numpy(), matrix(queries.column("q"))
            for u in np.intersect1d(dk, qk):
                at, qat = np.flatnonzero(dk == u), np.flatnonzero(qk == u)
                step = max(1, CELLS // len(at))
                for i in range(0, len(qat), step):
                    part = qat[i : i + step]
                    s = products(q[part], x[at])
                    for j, row in zip(part, s, strict=True):
                        keep = np.flatnonzero((row >= low[j]) & (ids[at] != qids[j]))
                        order = keep[np.lexsort((ids[at[keep]], -row[keep]))]
                        _, first = np.unique(ids[at[order]], return_index=True)  # repeated rows of an id count once
                        order = order[np.sort(first)[:k]]
                        out.append((np.full(len(order), qids[j]), ids[at[order]], row[order]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return run


def voronoi_topk(rows: DataFrame, query_rows: DataFrame, k: int = K, n_pivots: int = PIVOTS, n_witnesses: int = WITNESSES, block_rows: int = BLOCK_ROWS, query_block_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, v) rows whose components are whole numbers."""
    spark = rows.sparkSession
    ids, witnesses = sample(rows, n_witnesses)
    if not len(ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = witnesses[:n_pivots]
    grouped = materialize(rows.mapInArrow(_assign(pivots), "vec_id long, v array<double>, g int, dist double"), "voronoi")
    summary = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()  # a row a pivot
    radius, blocks = np.full(len(pivots), -1.0), [1] * len(pivots)
    for s in summary:
        radius[s["g"]], blocks[s["g"]] = s["r"], math.ceil(s["n"] / block_rows)
    queries = query_rows.select("vec_id", "v").mapInArrow(_bound(ids, witnesses, pivots, radius, k), "query_id long, q array<double>, low long, g int")
    n_queries = query_rows.count()
    query_blocks = max(1, math.ceil(n_queries / query_block_rows))
    n_blocks = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("g") + 1)
    buckets = max(8, sum(blocks) // 4) * query_blocks
    sent = (
        queries.withColumn("qb", unit("query_id", buckets=query_blocks))
        .withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .withColumn("bucket", unit("g", "block", "qb", buckets=buckets))
    )
    needed = queries.select("g", unit("query_id", buckets=query_blocks).alias("qb")).distinct() if query_blocks > 1 else queries.select("g", F.lit(0).alias("qb")).distinct()
    kept = (
        grouped.select("vec_id", "v", "g").withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int"))
        .join(needed, "g")
        .withColumn("bucket", unit("g", "block", "qb", buckets=buckets))
    )
    found = kept.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    return best(found, k)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector with all the others."""
    rows = quantised(valid(table(spark, sf_dir, "embeddings")))
    return voronoi_topk(rows, rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0))
