"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from pieces of good, one from pieces of bad labelled texts. A text
is cut into pieces of ``PIECE`` bytes, each compressed with either dictionary; with g and h the summed sizes
(frame overhead taken off), (h - g) / (g + h) says how much better the good dictionary fits, whatever the
length. That difference, with the share (g + h) / 2 bytes that is left after compression, so that mere
repetition, which any dictionary shrinks, is told apart, goes through a quadratic logistic calibration fitted
on labelled texts that no dictionary has seen. The share is a compressed size too: nothing but compressed
sizes enters a score.

The fit reads at most ``FIT_ROWS`` labelled rows (those whose ids hash lowest) of at most ``FIT_BYTES`` bytes
each; everything is scored, whole. The model is two dictionaries of ``DICT_BYTES`` and a few floats.

Dirty input. Null and empty texts count as the same empty text and get the score of an empty piece. Rows of
``labels`` with a null id or quality are not learned from; an id labelled both ways is dropped, one labelled
twice alike counts once. If no label of one of the classes is there, every score is the smoothed share of
good labels (0.5 without any). Null ids are held out by no rule (held_out false). Repeated rows are scored
each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FIT_ROWS = 6000
FIT_BYTES = 65536
DICT_BYTES = 65536
PIECE = 512
LEVEL = 3
#: Bytes of a frame's header that tell nothing of the text.
OVERHEAD = 6
THRESHOLD = 0.7
RIDGE = 1e-3


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; with too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    if raw not in _compressors:
        _compressors[raw] = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False
        )
    return _compressors[raw]


def features(text: bytes, good: bytes, bad: bytes) -> tuple[float, float]:
    """(normalised difference, compressed share)."""
    a, b = _compressor(good), _compressor(bad)
    g = h = 0
    for p in pieces(text):
        g += max(1, len(a.compress(p)) - OVERHEAD)
        h += max(1, len(b.compress(p)) - OVERHEAD)
    return (h - g) / (g + h), (g + h) / 2 / max(1, len(text))


def _terms(x: np.ndarray) -> np.ndarray:
    d, r = x[:, 0] * 10, np.log(np.clip(x[:, 1], 1e-3, 1.5))
    return np.stack([np.ones(len(x)), d, r, d * d, d * r, r * r], 1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression by Newton's method."""
    t, w = _terms(x), np.zeros(6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        grad = t.T @ (p - y) / len(y) + ridge * w
        hess = (t * (p * (1 - p))[:, None]).T @ t / len(y) + ridge * np.eye(6)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Either a constant, or dictionaries and a calibration."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        y = np.array(labels, float)
        self.constant = (y.sum() + 1) / (len(y) + 2)
        self.good = self.bad = b""
        self.weights = None
        half = np.arange(len(y)) % 5 < 3  # three fifths for the dictionaries, the rest for the calibration
        if all(((y == c) & h).any() for c in (0, 1) for h in (half, ~half)):
            parts = {c: [p for t, k, h in zip(texts, y, half, strict=True) if h and k == c for p in pieces(t) if p] for c in (1, 0)}
            self.good, self.bad = (dictionary(parts[c][:: max(1, len(parts[c]) // 24000)]) for c in (1, 0))
            seen = [(features(t, self.good, self.bad), k) for t, k, h in zip(texts, y, half, strict=True) if not h]
            self.weights = calibrate(np.array([f for f, _ in seen]), np.array([k for _, k in seen]))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.good, self.bad) for t in texts])
        return 1 / (1 + np.exp(-np.clip(_terms(x) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
        .where(F.col("low") == F.col("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    got = (
        docs.select("doc_id", "text")
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
        .join(F.broadcast(known), "doc_id")  # FIT_ROWS rows at most
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(rows)
        .select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "quality")
        .toArrow()
    )
    return Model(got.column("text").to_pylist(), got.column("quality").to_pylist())


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and qscore of every row; the input may hold any columns."""
    keep = docs.columns if keep is None else keep
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    fields = ", ".join(f"c{i} {wide.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = model.score(b.column("bytes").to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(s, pa.float64())], names=[*[f"c{i}" for i in range(len(keep))], "qscore"])

    scored = wide.mapInArrow(run, f"{fields}{', ' * bool(keep)}qscore double")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "qscore")


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("qscore").alias("score"), (F.col("qscore") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier doesn't reject, with all their columns."""
    scored = score(docs, fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return scored.where(F.col("qscore") >= THRESHOLD).drop("qscore")
