"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A ``.model`` file is compiled into: a normaliser (dummy prefix, white-space escape), a lexicon whose arcs read
a piece's characters and write its id, byte-fallback arcs for characters the lexicon lacks, and an acceptor
over neighbouring pieces. Composed with an input, they make a lattice whose states are (position, last piece);
the encoding is its shortest path in the tropical semiring (min, +), found in one forward sweep.

The acceptor is what makes this right for BPE models, where the library's result isn't the cheapest path by
any piece weights: it lets (u, v) pass only if merging the characters of u and v together gives u and v again.
A sequence whose neighbours all pass is the result of the merges, and there is one, so every arc may weigh 1.
It is built lazily, pair by pair. For unigram models it accepts all pairs and arcs weigh minus the piece's
score. As there is one accepted path to each position, the sweep of a BPE unit may go depth first, longest arcs first,
and stop at the end: what it leaves out can't lead there. Inputs are composed unit by unit (white space with the characters up to the next), since no piece has
white space after another character; units' paths are kept in a bounded cache.

Dirty input. Null text encodes as null and decodes as null; empty text as no ids. Characters outside the
vocabulary, controls and line feeds come out as byte pieces and decode to themselves. A literal U+2581 is
normalised white space, as in the library. Ids outside the vocabulary make decoding fail. Models with user
symbols or a compiled character map are refused. Repeated rows are encoded each; an empty table gives no
rows; input columns are kept under their names, whatever they are, beside those that the caller names.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE = 250_000
#: Pairs of pieces whose acceptance is remembered.
PAIRS = 300_000
MARKS = ".,;:!?"
BATCH_TOKENS = 1_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7)
        if n is None:
            n = varint()
        yield key >> 3, raw[i : i + n]
        i += n


class Transducer:
    def __init__(self, raw: bytes):
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.text: list[bytes] = []
        self.byte_ids = [0] * 256
        self.kind, self.prefix, self.trim, self.escape, self.unknown = UNIGRAM, True, True, True, 0
        for number, value in fields(raw):
            if number == 1:
                self._piece(dict(fields(value)))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2):
                    raise NotImplementedError("a compiled character map")
                self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise NotImplementedError(f"model type {self.kind}")
        #: The lexicon's states: every beginning of a piece, with the piece's id where one ends.
        self.states = {p[:n]: None for p in self.ids for n in range(1, len(p) + 1)}
        self.states = {p: self.ids.get(p, -1) for p in self.states}
        #: The same states as nested dictionaries by character; a piece's own text is under "".
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = p
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # what no piece holds ends one
        self.by_units = not any(SPACE in p.lstrip(SPACE) for p in self.ids) and self.escape
        self.unknown_cost = 10 - min(self.score, default=0.0)
        self.passes: dict[str | None, dict[str, bool]] = {}
        self.n_passes = 0
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, p: dict) -> None:
        name, kind, at = p[1].decode(), p.get(3, NORMAL), len(self.text)
        self.score.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
        self.text.append(name.replace(SPACE, " ").encode() if kind == NORMAL else b"")
        if kind == NORMAL:
            self.ids[name] = at
        elif kind == BYTE:
            self.byte_ids[int(name[3:5], 16)] = at
            self.text[at] = bytes([int(name[3:5], 16)])
        elif kind == UNKNOWN:
            self.unknown = at
            self.text[at] = " ⁇ ".encode()
        elif kind == USER:
            raise NotImplementedError("user-defined symbols")

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """The characters after merging, best score first, leftmost on a tie."""
        parts = [*text]
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def accepts(self, u: str | None, v: str) -> bool:
        """Whether piece v may follow piece u (None: a start, or a character outside the lexicon)."""
        if self.kind == UNIGRAM:
            return True
        return self.merged((u or "") + v) == ([u, v] if u else [v])

    def deepest(self, unit: str) -> list[int] | None:
        """``shortest`` for BPE and characters of the lexicon, depth first; None if no path is found."""
        trie, ids, passes, n = self.trie, self.ids, self.passes, len(unit)
        i, u, left = 0, None, []  # left: (position, last piece, arcs not tried yet) of each state on the path
        while i < n:
            node, arcs = trie, []
            for ch in unit[i:] if i else unit:
                node = node.get(ch)
                if node is None:
                    break
                if "" in node:
                    arcs.append(node[""])
            while True:
                after = passes.get(u)
                if after is None:
                    after = passes[u] = {}
                v = None
                while arcs:
                    v = arcs.pop()
                    ok = after.get(v)
                    if ok is None:
                        ok = after[v] = self.accepts(u, v)
                        self.n_passes += 1
                    if ok:
                        break
                    v = None
                if v is not None:
                    break
                if not left:
                    return None
                i, u, arcs = left.pop()
            left.append((i, u, arcs))
            i, u = i + len(v), v
        return [*(ids[p] for _, p, _ in left[1:]), ids[u]] if left else []

    def shortest(self, unit: str) -> list[int]:
        """Ids on the shortest path through the lattice of a normalised unit."""
        if self.n_passes > PAIRS:
            self.passes, self.n_passes = {}, 0
        if self.kind == BPE and all(map(self.ids.__contains__, unit)) and (found := self.deepest(unit)) is not None:
            return found
        return self.swept(unit)

    def swept(self, unit: str) -> list[int]:
        """``shortest`` position by position."""
        states, n, bpe = self.states, len(unit), self.kind == BPE
        cost, last, back = [math.inf] * (n + 1), [None] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here = cost[i]
            if here == math.inf:
                continue
            u = last[i]
            after = self.passes.get(u)
            if after is None:
                after = self.passes[u] = {}
            for j in range(i + 1, n + 1):
                v = unit[i:j]
                k = states.get(v)
                if k is None:
                    break
                if k < 0:
                    continue
                c = here + 1.0 if bpe else here - self.score[k]
                if c < cost[j]:
                    ok = after.get(v)
                    if ok is None:
                        ok = after[v] = self.accepts(u, v)
                        self.n_passes += 1
                    if ok:
                        cost[j], last[j], back[j] = c, v, i
            if unit[i] not in self.ids and here + self.unknown_cost < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = here + self.unknown_cost, None, i
        if cost[n] == math.inf:
            raise ValueError(f"no path for {unit[:40]!r}")
        out, i = [], n
        while i:
            if last[i] is None:
                out += [self.byte_ids[b] for b in reversed(unit[back[i] : i].encode())]
            else:
                out.append(self.ids[last[i]])
            i = back[i]
        return out[::-1]

    def _path(self, u: str) -> bytes:
        """A unit's ids. Closing marks are a unit of their own where no piece holds the boundary before them."""
        core = u.rstrip(MARKS)
        if core and core != u and u[len(core) - 1 : len(core) + 1] not in self.inside:
            return self._known(core) + self._known(u[len(core) :])
        return np.array(self.shortest(u), "<i4").tobytes()

    def _known(self, u: str) -> bytes:
        out = self.cache.get(u)
        if out is None:
            out = self.old.get(u)
            self.cache[u] = out = self._path(u) if out is None else out
        return out

    def _add(self, units: list[str]) -> None:
        if len(self.cache) > CACHE:  # the younger generation becomes the elder
            self.old, self.cache = self.cache, {}
        for u in set(units).difference(self.cache):
            self._known(u)

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        if not text:
            return np.zeros(0, np.int32)
        units = UNIT.findall(text) if self.by_units else [text]
        try:
            return np.frombuffer(b"".join(map(self.cache.__getitem__, units)), "<i4")
        except KeyError:
            self._add(units)
            return np.frombuffer(b"".join(map(self.cache.__getitem__, units)), "<i4")

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


#: White space with the characters up to the next white space or line feed (no piece holds a line feed).
UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_compiled: dict[str, Transducer] = {}


def transducer(name: str = MODEL) -> Transducer:
    if name not in _compiled:
        with open(public_tokenizers.path(name), "rb") as f:
            _compiled[name] = Transducer(f.read())
    return _compiled[name]


def _mapped(df: DataFrame, source: str, out: str, kind: str, run) -> DataFrame:
    """``df`` with one more column, made from ``source`` list by list."""
    names = df.columns
    wide = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(wide.schema.fields))
    at = names.index(source)

    def batches(it):
        for b in it:
            for begin, new in run(b.column(at)):
                yield pa.RecordBatch.from_arrays([*b.slice(begin, len(new)).columns, new], names=[*[f"c{i}" for i in range(len(names))], "new"])

    return wide.mapInArrow(batches, f"{schema}, new {kind}").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("new").alias(out))


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with the ids of its texts."""

    def run(texts):
        own, begin, held, size = transducer(model), 0, [], 0

        def packed():
            lengths = np.array([0 if x is None else len(x) for x in held])
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = np.concatenate([x for x in held if x is not None] or [np.zeros(0, np.int32)])
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in held]))

        for x in texts:
            t = x.as_py()
            held.append(None if t is None else own.encode(t))
            size += 0 if t is None else len(held[-1])
            if size >= BATCH_TOKENS:
                yield begin, packed()
                begin, held, size = begin + len(held), [], 0
        if held:
            yield begin, packed()

    return _mapped(df, text_col, out, "array<int>", run)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of its ids."""

    def run(lists):
        own = transducer(model)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        valid = lists.is_valid().to_pylist()
        step = max(1, int(BATCH_TOKENS // max(1, len(flat) / max(1, len(lists)))))
        for i in range(0, len(lists), step):
            rows = range(i, min(len(lists), i + step))
            yield i, pa.array([own.decode(flat[ends[k] : ends[k + 1]].tolist()) if valid[k] else None for k in rows], pa.string())

    return _mapped(df, ids_col, out, "string", run)


def _crc(lists):
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    yield 0, pa.array([zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def op2_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids' number and crc32 (little-endian 32-bit), and whether decoding them gives the
    whole text again (null for null text). A text that itself holds U+2581 decodes to spaces there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = _mapped(decode(encode(docs)), "ids", "crc", "long", _crc)
    n = F.when(F.col("text").isNotNull(), F.size("ids").cast("long"))
    return back.select(
        "doc_id", n.alias("n_pieces"), F.when(F.col("text").isNotNull(), F.col("crc")).alias("ids_crc32"), (F.replace("text", F.lit(SPACE), F.lit(" ")) == F.col("decoded")).alias("restored")
    )


def encoded_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row with its ids in place of its text."""
    ids = encode(docs.select("doc_id", "lang", "source", "text"), out="piece_ids")
    return ids.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids")
