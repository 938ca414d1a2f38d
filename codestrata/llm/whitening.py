"""Embedding whitening by a two-pass covariance.

Vectors become integers, x = floor(scale * c) + offset, and each distinct x counts once in the fit (the fit list). The
first pass adds the integers up exactly, which gives the mean without rounding. The second centres every vector, adds
the outer products of a block by one matrix product, and merges the matrices of the partitions by ``treeAggregate``.
LAPACK's symmetric eigensolver runs on the driver, on one d x d matrix; the projection goes to the tasks with the mean.
A third pass whitens the fit list itself and measures how far its covariance is from the identity.

What is moved: a task sends one d-vector in the first pass and one d x d matrix in the second, merged in the executors in
``DEPTH`` levels, so that the driver gets a few; d is at most ``WIDEST``. The distinct vectors are the only shuffle;
equal vectors combine before it, whatever their number.

Exactness. Integers are added in two halves of 32 bits, so sums of 2^31 rows a task are exact for any long. The deviation
sum((n * x - S)^2) is computed in 64 bits where a bound allows it, in Python's integers otherwise. ``scale * c`` beyond 2^61
either way counts as 2^61.

Dirty input. Rows go whose vector is null, empty or has a null or non-finite entry, or whose dimension is not the
commonest one (ties: the smaller), between which no covariance is defined. Null and repeated ids stay, each row is returned. A
deviation that no long holds is null. Components whose eigenvalue is zero to double precision (fewer distinct vectors than
dimensions, constant or dependent entries) have no scale: whitened is null and they count in no identity error, which is
null if there is no other component; explained is null if the whole covariance is zero. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import matrix

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
WIDEST = 4096
DEPTH = 3
BLOCK_BYTES = 8 << 20
LARGEST = float(2**61)


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id long, x array<long>) of the rows that take part."""
    big = F.lit(float("inf"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big))
    )
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    rows = rows.where(F.size("v") == (dims[0]["dim"] if dims else 0))
    bounded = lambda c: F.greatest(F.least(c * float(scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(bounded(c)) + F.lit(offset)).alias("x"))


def _blocks(batches, column: str = "x"):
    """(batch, first row, matrix of longs) in blocks of bounded size."""
    for b in batches:
        if b.num_rows:
            m = matrix(b.column(column), np.int64)
            step = max(1, BLOCK_BYTES // (8 * m.shape[1]))
            for at in range(0, len(m), step):
                yield b, at, m[at : at + step]


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""

    def part(batches):
        n, low, high = 0, 0, 0
        for _, _, m in _blocks(batches):
            n += len(m)
            low = low + (m & 0xFFFFFFFF).sum(0)
            high = high + (m >> 32).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low.tolist()]), pa.array([high.tolist()])], names=["n", "low", "high"])

    def add(a, r):
        both = [lo + (hi << 32) for lo, hi in zip(r["low"], r["high"], strict=True)]
        return a[0] + r["n"], [x + y for x, y in zip(a[1], both, strict=True)] if a[1] else both

    def merge(a, b):
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)] if a[1] and b[1] else a[1] or b[1]

    parts = fit.select("x").mapInArrow(part, "n long, low array<long>, high array<long>")
    return parts.rdd.treeAggregate((0, []), add, merge, DEPTH)


@dataclass
class Centre:
    """Exact mean S / n: a long part to take off first, and what is left of it."""

    n: int
    total: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.total], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.total])

    def off(self, m: np.ndarray) -> np.ndarray:
        return (m - self.whole).astype(np.float64) - self.rest

    def deviation(self, m: np.ndarray) -> list[int | None]:
        """sum((n * x - S)^2) of each row, exact; None beyond a long."""
        gap = m - self.whole  # n * x - S = n * gap - remainder, 0 <= remainder < n
        left = np.array([s % self.n for s in self.total], np.int64)
        most = (int(np.abs(gap).max(initial=0)) + 1) * self.n
        if most * most * m.shape[1] < 2**63:
            d = gap * self.n - left
            return (d * d).sum(1).tolist()
        exact = [sum((g * self.n - r) ** 2 for g, r in zip(row, left.tolist(), strict=True)) for row in gap.tolist()]
        return [e if e < 2**63 else None for e in exact]


def _products(rows: DataFrame, width: int, of) -> np.ndarray:
    """Sum over all rows of the outer products of ``of(block)`` with itself, and their sum as last line."""

    def part(batches):
        total = None
        for _, _, m in _blocks(batches):
            w = of(m)
            made = np.concatenate([w.T @ w, w.sum(0, keepdims=True)])
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(a, r):
        m = np.frombuffer(bytes(r["m"])).reshape(width + 1, width)
        return m if a is None else a + m

    def merge(a, b):
        return b if a is None else a if b is None else a + b

    got = rows.select("x").mapInArrow(part, "m binary").rdd.treeAggregate(None, add, merge, DEPTH)
    return np.zeros((width + 1, width)) if got is None else got


@dataclass
class Whitening:
    """What ``fit`` learns: everything to whiten a vector, and how well it whitens the fit list."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def whitened(self, m: np.ndarray) -> np.ndarray:
        """One column a component, NaN where its eigenvalue is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centre.off(m) @ self.components / np.sqrt(self.values), np.nan)


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learns from the distinct vectors of ``x``; None if there are none. Raises for more than ``WIDEST`` dimensions."""
    once = materialize(x.select("x").distinct(), "distinct-vectors")
    n, total = sums(once)
    if not n:
        return None
    d = len(total)
    if d > WIDEST:
        raise ValueError(f"{d} dimensions, {WIDEST} at most: the driver solves one matrix of that width")
    centre = Centre(n, total)
    cov = _products(once, d, centre.off)[:d] / n
    cov = (cov + cov.T) / 2
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    values = np.where(values > values[0] * d * np.finfo(float).eps, values, 0.0)
    trace = float(np.trace(cov))
    made = Whitening(centre, np.ascontiguousarray(vectors), values, [float(v) / trace if trace > 0 else None for v in values])
    live = values > 0
    if live.any():
        got = _products(once, len(values), lambda m: np.nan_to_num(made.whitened(m)))
        mean = got[-1] / n
        off = got[:-1] / n - np.outer(mean, mean) - np.eye(len(values))
        made.identity_error = float(np.abs(off[np.ix_(live, live)]).max())
    return made


def whiten(x: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row a row of ``x`` and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    k = len(model.values)

    def run(batches):
        for b, at, m in _blocks(batches):
            rows, w = len(m), model.whitened(m).reshape(-1)
            place = pa.array(np.repeat(np.arange(at, at + rows), k))
            deviation = pa.array(model.centre.deviation(m), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.centre.n)), deviation,
                    pa.array(w, mask=np.isnan(w)), pa.array(model.explained * rows, pa.float64()), pa.array([model.identity_error] * (rows * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, schema)


def op12_two_pass_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = integers(table(spark, sf_dir, "embeddings"))
    return whiten(x, fit(x))
