"""Toxicity by compression distance over windows.

A text is cut into windows of ``WORDS`` words. Each window is compressed twice by zstandard, with a dictionary
trained on toxic and with one trained on ordinary labelled text; the bytes that the toxic dictionary saves are
the window's distance. A window that saves at least a threshold counts as marked, and the share of marked
windows goes through a logistic calibration, so that a long text is not toxic for one chance match and a short
one not clean for its few windows. Threshold and calibration come from labelled texts that no dictionary has seen.

What makes the distance of such small windows sharp:

* Both dictionaries end in the same ``BASE_BYTES`` of ordinary text. Whatever that explains costs equally many bytes
  under either, so windows of common words have distance zero instead of noise.
* The parts that differ, of ``PART_BYTES`` each, are trained by zstandard (its cover algorithm keeps what repeats).
  A toxic text is mostly ordinary prose, and a label may be wrong, so the toxic part is trained on the windows
  that *other* toxic texts explain: the toxic texts are dealt into two halves by checksum of the text, copies
  to the same half, and a window of one half stays if the dictionary of the other half saves ``MINED`` bytes on it.
  ``ROUNDS`` of this leave what toxic texts share and ordinary ones lack.
* A fixed mark that both dictionaries hold follows each window. It pays for the frame's fixed cost; without it zstandard
  stores windows of some 20 bytes raw, whatever they hold.

The fit reads the ``FIT_TOXIC`` and ``FIT_ORDINARY`` labelled rows whose ids hash lowest, of at most ``FIT_BYTES``
bytes each, and weighs them by how many labelled rows there are of either class; everything is scored, whole, in
pieces of ``CHUNK_BYTES``. The model is two dictionaries and a few floats.

Dirty input. Null and empty texts have no window and get the score of a text with none marked. ASCII letters are lower-cased,
words are cut at ASCII white space, a window longer than ``LONGEST`` bytes is cut further. Rows of ``labels``
with a null id or toxic are not learned from; an id labelled both ways is dropped, one labelled twice alike counts once. If
one of the classes has no text with words for the dictionaries or for the calibration, every score is the smoothed share
of toxic labels (0.5 without any). Null ids are held out by no rule (held_out false). Repeated rows are scored each;
an empty table gives no rows; other columns are kept or not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import held_out

FIT_TOXIC = 1500
FIT_ORDINARY = 4000
FIT_BYTES = 32768
WORDS = 3
LONGEST = 256
BASE_BYTES = 1 << 21
FIRST_BYTES = 1 << 17
PART_BYTES = 1 << 13
ROUNDS = 3
MINED = 3
THRESHOLDS = (1, 2, 3, 4, 5)
CHUNK_BYTES = 1 << 20
THRESHOLD = 0.7
RIDGE = 1e-4
FOLDS, FOLD = 3, 1

#: Bytes that UTF-8 never holds, so that no text contains the mark.
MARK = bytes([0xF8, 0xFD, 0xFA, 0xFF, 0xF9, 0xFC, 0xFE, 0xFB, 0xF8, 0xFF, 0xFC, 0xFA])

_SETTINGS = zstandard.ZstdCompressionParameters(
    window_log=22, chain_log=22, hash_log=22, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY,
    write_content_size=False, write_checksum=False, write_dict_id=False,
)


def windows(text: bytes, words: int = WORDS, longest: int = LONGEST) -> list[bytes]:
    """The text's windows, lower-cased, words joined and enclosed by one space."""
    w = text.lower().split()
    out = [b" %s " % b" ".join(w[i : i + words]) for i in range(0, len(w), words)]
    if max(map(len, out), default=0) > longest:
        out = [x[i : i + longest] for x in out for i in range(0, len(x), longest)]
    return out


class Compressor:
    """Compressed sizes of many windows at once under one raw dictionary."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._zstd = None

    def __getstate__(self) -> bytes:
        return self.raw

    def __setstate__(self, raw: bytes) -> None:
        self.__init__(raw)

    def sizes(self, parts: list[bytes]) -> np.ndarray:
        if not parts:
            return np.zeros(0, np.int64)
        if self._zstd is None:
            content = zstandard.ZstdCompressionDict(self.raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._zstd = zstandard.ZstdCompressor(dict_data=content, compression_params=_SETTINGS)
        length = np.fromiter(map(len, parts), np.uint64, len(parts)) + np.uint64(len(MARK))
        begin = np.concatenate([np.zeros(1, np.uint64), np.cumsum(length)[:-1]])
        segments = np.stack([begin, length], 1).tobytes()
        packed = self._zstd.multi_compress_to_buffer(zstandard.BufferWithSegments(MARK.join([*parts, b""]), segments), threads=1)
        return np.fromiter(map(len, packed), np.int64, len(parts))


def _trained(parts: list[bytes], size: int) -> bytes:
    """``size`` bytes of dictionary; with too little to train on, the windows themselves."""
    try:
        made = zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        made = b"".join(parts)
    return made[-size:].rjust(size, b" ")


def _drawn(parts: list[bytes], size: int, seed: int) -> bytes:
    """``size`` bytes of windows in random order, blanks in front if there are too few."""
    order = np.random.default_rng(seed).permutation(len(parts))
    length = np.fromiter((len(parts[i]) for i in order), np.int64, len(order))
    enough = int(np.searchsorted(np.cumsum(length), size)) + 1
    return b"".join(parts[i] for i in order[:enough])[:size].rjust(size, b" ")


def _half(text: bytes) -> int:
    return zlib.crc32(text) & 1


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary from texts of either class."""
    plain = [w for t in ordinary for w in windows(t)]
    base = _drawn(plain, BASE_BYTES, 1) + MARK
    halves = [[w for t in toxic if _half(t) == side for w in windows(t)] for side in (0, 1)]
    against = Compressor(_drawn(plain, FIRST_BYTES, 2) + base)
    makers = [Compressor(_drawn(h, FIRST_BYTES, 3) + base) for h in halves]
    usual = _trained(plain, PART_BYTES) + base
    mined = halves
    for _ in range(ROUNDS):
        saved = [against.sizes(h) - makers[1 - side].sizes(h) for side, h in enumerate(halves)]
        mined = [[w for w, s in zip(h, gain, strict=True) if s >= MINED] for h, gain in zip(halves, saved, strict=True)]
        makers = [Compressor(_trained(m, PART_BYTES) + base) for m in mined]
        against = Compressor(usual)
    return _trained(mined[0] + mined[1], PART_BYTES) + base, usual


def _terms(marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    share, size = np.log((marked + 0.5) / (total + 10)), np.log(total + 10)
    return np.stack([np.ones(len(share)), share, size, share * size], 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(terms: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weighted logistic regression by Newton's method, from ``w`` on; ``y`` may be shares."""
    for _ in range(100):
        p = _sigmoid(terms @ w)
        grad = terms.T @ (weight * (p - y)) + ridge * w
        hess = (terms * (weight * p * (1 - p))[:, None]).T @ terms + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 3 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(terms: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, (share of clean texts labelled toxic, of toxic ones labelled clean), mean log likelihood).

    Labels err. A logistic regression that must explain them all is flat where it should be steep, so the two
    shares of wrong labels are fitted with it, by expectation and maximisation.
    """
    weight, wrong, w = weight / weight.sum(), np.array([0.05, 0.05]), np.zeros(terms.shape[1])
    w[1] = 1.0
    for _ in range(rounds):
        p = _sigmoid(terms @ w)
        is_toxic = np.where(y == 1, p * (1 - wrong[1]) / (p * (1 - wrong[1]) + (1 - p) * wrong[0]), p * wrong[1] / (p * wrong[1] + (1 - p) * (1 - wrong[0])))
        wrong = np.clip([(weight * (1 - is_toxic))[y == 1].sum() / max(1e-9, (weight * (1 - is_toxic)).sum()), (weight * is_toxic)[y == 0].sum() / max(1e-9, (weight * is_toxic).sum())], 1e-4, 0.25)
        w = _logistic(terms, is_toxic, weight, w)
    said = np.clip(labelled(_sigmoid(terms @ w), wrong), 1e-9, 1 - 1e-9)
    return w, wrong, float((weight * (y * np.log(said) + (1 - y) * np.log(1 - said))).sum())


def labelled(p: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """The chance of the label toxic of texts that are toxic with chance ``p``."""
    return p * (1 - wrong[1]) + (1 - p) * wrong[0]


class Model:
    """Either a constant, or two dictionaries, the least saving that marks a window, and a calibration."""

    def __init__(self, texts: list[bytes], labels: list[int], share: float | None = None):
        """``share`` is the part of toxic ones among all labels, if the texts don't show it."""
        y = np.array(labels, float)
        held = np.arange(len(y)) % 5 >= 3  # three fifths for the dictionaries, the rest for the calibration
        self.constant = (y.sum() + 1) / (len(y) + 2) if share is None else share
        self.toxic = self.ordinary = self.weights = self.wrong = None
        self.least = THRESHOLDS[0]
        told = np.array([bool(t.strip()) for t in texts], bool)
        if not all(((y == c) & told & side).any() for c in (0, 1) for side in (held, ~held)):
            return
        seen = [[t for t, k, h in zip(texts, y, held, strict=True) if not h and k == c] for c in (1, 0)]
        self.toxic, self.ordinary = map(Compressor, dictionaries(*seen))
        late, truth = [t for t, h in zip(texts, held, strict=True) if h], y[held]
        whole = np.array([self.constant, 1 - self.constant])
        weight = np.where(truth == 1, whole[0] / max(1, truth.sum()), whole[1] / max(1, (1 - truth).sum()))
        of, saved = self.distances(late)
        total = np.bincount(of, minlength=len(late))
        fits = [(calibrate(_terms(np.bincount(of[saved >= k], minlength=len(late)), total), truth, weight), k) for k in THRESHOLDS]
        (self.weights, self.wrong, _), self.least = max(fits, key=lambda f: (f[0][2], -f[1]))

    def distances(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, bytes that the toxic dictionary saves) of every window of every text."""
        cut = [windows(t) for t in texts]
        flat = [w for c in cut for w in c]
        return np.repeat(np.arange(len(texts)), [len(c) for c in cut]).astype(np.int64), self.ordinary.sizes(flat) - self.toxic.sizes(flat)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(marked windows, windows) of each text; long texts and lists go in pieces."""
        marked, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if self.weights is None:
            return marked, total
        for places, part in _pieces(texts):
            of, saved = self.distances(part)
            marked += np.bincount(places[of[saved >= self.least]], minlength=len(texts))
            total += np.bincount(places[of], minlength=len(texts))
        return marked, total

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.chances(*self.counts(texts))

    def chances(self, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Score of texts of so many marked windows among so many."""
        if self.weights is None:
            return np.full(len(total), self.constant)
        return labelled(_sigmoid(_terms(marked, total) @ self.weights), self.wrong)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(places, pieces) of about CHUNK_BYTES in all; a longer text is cut after a white space where it has one."""
    places, held, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = at + CHUNK_BYTES
            if end < len(t):
                end = max((t.rfind(s, at, end) for s in (b" ", b"\n")), default=-1) + 1 or end
            places.append(i)
            held.append(t[at:end])
            size += min(end, len(t)) - at
            at = end
            if size >= CHUNK_BYTES:
                yield np.array(places), held
                places, held, size = [], [], 0
    if held:
        yield np.array(places), held


def fit(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, ordinary: int = FIT_ORDINARY, most_bytes: int = FIT_BYTES) -> Model:
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id", FOLDS, FOLD))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("low"), F.max("toxic").cast("int").alias("toxic"))
        .where(F.col("low") == F.col("toxic"))
        .select("doc_id", "toxic")
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    taken = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(ordinary))
    got = (
        docs.select("doc_id", "text")
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
        .join(F.broadcast(taken), "doc_id")  # FIT_TOXIC + FIT_ORDINARY rows at most
        .orderBy(*order, "text")
        .limit(toxic + ordinary)
        .select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "toxic")
        .toArrow()
    )
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return Model(got.column("text").to_pylist(), got.column("toxic").to_pylist(), share)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), n_windows, n_marked and toxicity of every row; the input may hold any columns."""
    keep = docs.columns if keep is None else keep
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("bytes"))
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{c} {wide.schema[c].dataType.simpleString()}, " for c in names) + "n_windows long, n_marked long, toxicity double"

    def run(batches):
        for b in batches:
            texts = b.column("bytes").to_pylist()
            marked, total = model.counts(texts)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(total), pa.array(marked), pa.array(model.chances(marked, total), pa.float64())], names=[*names, "n_windows", "n_marked", "toxicity"])

    scored = wide.mapInArrow(run, fields)
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[c for c in ("n_windows", "n_marked", "toxicity") if c not in keep])


def op11_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "n_marked"
    )
