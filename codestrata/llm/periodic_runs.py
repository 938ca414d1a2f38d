"""Runs of repeating words: a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(LEAST, TIMES * q)`` words, which no neighbouring word extends keeping period q. For each period p the text is
sampled at 0, p, 2p ...; how far two neighbouring samples jp and (j+1)p agree forwards, f, and backwards, b, gives the
stretch [jp - b, (j+1)p + f) of period p, and every run of period p holds such a pair. Over all p that are n/p
pairs each, n log n in all. An extension is the minimum of a range of the suffix array's neighbour agreements
(f: of the words, b: of the reversed words), looked up in a sparse table.

* A run of at least TIMES = 4 periods holds four samples in a row, and all four words are equal. Pairs that don't begin
  such a row have an extension that is too short, so only the others are looked up. Texts without any have no run, and
  need no suffix array. Nothing else is left out.
* A stretch of period p that has a smaller period q too is found under both, with the same ends: the length is at least
  p + q, so q divides p and neither can be extended alone. The smallest period of equal ends is the run's.
* Texts go in batches of about ``BATCH_WORDS`` words. Words are numbered anew in each text, so that suffixes of different
  texts differ at once and copies of a text cost nothing extra. A suffix array comes from doubling; only suffixes that are
  still equal to another go on to the next round. Memory is n log n numbers for the longest text; grid pairs go
  in blocks of ``BLOCK_PAIRS``.

A text is the unit of work and no row is moved, so there is nothing to skew but the length of single texts.

Dirty input. Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes, compared as they are. Null and empty texts have no words and no
runs. Null ids are kept. Repeated rows are answered each; an empty table gives no rows; other columns are kept or not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST = 6
TIMES = 4
BATCH_WORDS = 1 << 16
BLOCK_PAIRS = 1 << 20


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, place of each suffix in it, names of all stretches of 1, 2, 4 ... as far as they were needed)."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    # A name is the number of suffixes that are smaller, so that only equal names change from round to round.
    rank = np.concatenate([[0], np.cumsum(np.bincount(rank))])[rank]
    names, step = [rank], 1
    count = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(count[rank] > 1)
    while len(open_):
        far = open_ + step
        key = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        order = np.lexsort((key, rank[open_]))
        at, k, r = open_[order], key[order], rank[open_][order]
        fresh = np.concatenate([[True], r[1:] != r[:-1]])
        split = fresh | np.concatenate([[True], k[1:] != k[:-1]])
        place = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(fresh, place, 0))
        named = r + np.maximum.accumulate(np.where(split, place, 0)) - begin
        rank = rank.copy()
        rank[at] = named
        names.append(rank)
        same = np.concatenate([~split[1:], [False]]) | ~split
        open_ = np.sort(at[same])
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank, names


def neighbour_agreement(order: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix of the array agrees in with the one before it (first: 0), by halving stretches."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, np.int64)
    for k in range(len(names) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (names[k][np.minimum(a, n - 1)] == names[k][np.minimum(b, n - 1)])
        # Names of suffixes that are shorter than the stretch are unique, so equal names mean whole stretches.
        out[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


class Extensions:
    """Longest common extension of any two places: a range minimum over neighbour agreements."""

    def __init__(self, s: np.ndarray):
        order, self.rank, names = suffix_order(s)
        table_ = [neighbour_agreement(order, names).astype(np.int32)]
        width = 1
        while 2 * width <= len(s):
            table_.append(np.minimum(table_[-1][:-width], table_[-1][width:]))
            width *= 2
        self.n, self.table = len(s), table_

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a and b differ; a place at or beyond the end agrees in nothing."""
        out = np.zeros(len(a), np.int64)
        ok = np.flatnonzero((a < self.n) & (b < self.n) & (a >= 0) & (b >= 0))
        x, y = self.rank[a[ok]], self.rank[b[ok]]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[ok[at]] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def _grid(lengths: np.ndarray, begins: np.ndarray):
    """(text, period, first sample) for all periods and rows of TIMES samples, in blocks of bounded size."""
    periods = np.where(lengths >= LEAST, lengths // TIMES, 0)
    texts = np.repeat(np.arange(len(lengths)), periods)
    p = np.arange(len(texts)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    rows = np.maximum(0, (lengths[texts] - 1) // p - (TIMES - 2)) if len(texts) else np.zeros(0, np.int64)
    edges = np.searchsorted(np.cumsum(rows), np.arange(0, rows.sum() + BLOCK_PAIRS, BLOCK_PAIRS))
    for lo, hi in zip(edges, [*edges[1:], len(rows)], strict=True):
        r = rows[lo:hi]
        if r.sum():
            t, q = np.repeat(texts[lo:hi], r), np.repeat(p[lo:hi], r)
            j = np.arange(len(t)) - np.repeat(np.cumsum(r) - r, r)
            yield t, q, begins[t] + j * q


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of (start, length, period), by start and period, for each text given as numbers of its words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    if not lengths.sum():
        return out
    begins, flat = np.cumsum(lengths) - lengths, np.concatenate(texts)
    pairs = []
    for t, p, at in _grid(lengths, begins):
        row = flat[at] == flat[at + p]
        for k in range(1, TIMES - 1):
            row[row] = flat[at[row] + k * p[row]] == flat[at[row] + (k + 1) * p[row]]
        pairs.append((t[row], p[row], at[row]))
    t, p, at = (np.concatenate([x[i] for x in pairs]) if pairs else np.zeros(0, np.int64) for i in range(3))
    if not len(t):
        return out
    kept = np.unique(t)
    new_begin = np.full(len(texts), -1, np.int64)
    new_begin[kept] = np.cumsum(lengths[kept]) - lengths[kept]
    # Words of different texts, and the ends of texts, never agree: word numbers are made unique across texts.
    most = int(flat.max()) + 1
    s = np.concatenate([texts[k] + i * most for i, k in enumerate(kept)])
    a = at - begins[t] + new_begin[t]
    b = a + p
    forward = Extensions(s)(a, b)
    mirror = len(s) - 1
    backward = Extensions(s[::-1])(mirror - (a - 1), mirror - (b - 1))
    start, length = a - backward - new_begin[t], p + forward + backward
    good = length >= np.maximum(LEAST, TIMES * p)
    found = np.unique(np.stack([t, start, length, p], 1)[good], axis=0)  # sorted; periods last
    first = np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(1)]) if len(found) else np.zeros(0, bool)
    found = found[first]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    limits = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    for k in kept:
        out[k] = found[limits[k] : limits[k + 1], 1:]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run repeats: every run keeps its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _answers(texts: list[bytes]) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """(words, runs, collapsed text) of each text, found in batches."""
    counts, runs, collapsed = [], [], []
    held: list[list[bytes]] = []

    def flush() -> None:
        got = find_runs([_numbered(w) for w in held])
        for w, r in zip(held, got, strict=True):
            kept = w if not len(r) else [x for x, k in zip(w, kept_words(len(w), r), strict=True) if k]
            counts.append(len(w))
            runs.append(r)
            collapsed.append(b" ".join(kept))
        held.clear()

    size = 0
    for t in texts:
        held.append(t.split())
        size += len(held[-1])
        if size >= BATCH_WORDS:
            flush()
            size = 0
    flush()
    return counts, runs, collapsed


RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), n_words, runs by start and period, and collapsed, the text's words joined by one
    space without what runs repeat. Columns of the input called like one of the three give way to it."""
    answers = ("n_words", "runs", "collapsed")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in answers]
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("bytes"))
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{c} {wide.schema[c].dataType.simpleString()}, " for c in names) + f"n_words bigint, runs {RUN}, collapsed binary"

    def run(batches):
        for b in batches:
            counts, runs, collapsed = _answers(b.column("bytes").to_pylist())
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], ["start", "length", "period"])
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(collapsed, pa.binary())],
                names=[*names, *answers],
            )

    found = wide.mapInArrow(run, fields)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, in which every tenth document (by checksum of its id) repeats from some word on, words joined by one space."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), "[ \\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    made = F.transform(
        F.array(F.struct(words.alias("w"), n.alias("n"), (g % F.greatest(n, F.lit(1))).alias("a"))),
        lambda s: F.array_join(
            F.transform(
                F.sequence(F.lit(0).cast("long"), s["n"] - 1),
                lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % (1 + F.floor((s["n"] - s["a"]) / (3 + g % 8)))).cast("int")),
            ),
            " ",
        ),
    )[0]
    return F.when((h % 10 == 0) & F.col(text_col).rlike("[^ \\x09-\\x0D]"), made).otherwise(F.col(text_col))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    found = periodic_runs(docs, keep=["doc_id"])
    # Greatest first: by length, then smallest start, then smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-F.col("best.l") * 1000 / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
