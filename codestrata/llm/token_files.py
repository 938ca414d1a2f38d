"""Token ids as Parquet list columns.

A token folder holds one file a range of document ids, in that order. Its rows are (doc_id, part, local_start,
n_tokens, ids): ``ids`` is a list column of dictionary-coded integers (the vocabulary makes a dictionary page
of 200 KB), the plain columns are delta coded, row groups are kept small and pages end at ``PAGE_BYTES``, so
that with the page indexes a reader of some documents reads only their pages, and a reader of lengths or
offsets reads no ids at all. ``part`` is the place of the file in the order; a document's place in the whole
stream is its ``local_start`` plus the tokens of all earlier parts, a sum over as many numbers as there are
files.

Encoding asks the tokenizers library for every distinct word once a worker (see ``Encoder``) and keeps a
bounded cache of the answers, found by 64-bit hashes of the words.

Dirty input. Null text counts as empty: one end id. A text that holds a special token's string gets that token, as the
library does by default. Null ids come first; equal ids are ordered by a hash of
the text, then the text; repeated rows are all written. An empty table gives an empty folder with the same
columns. Other columns are not looked at.
"""

from __future__ import annotations

import gc
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .attention_lm import ranges, runs
from .common import scratch_path, table
from .text import mix, powers_to

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
DICTIONARY_BYTES = 1 << 20
CACHE = 500_000
#: Units known by their hashes, some 50 bytes each, before those not met lately are forgotten.
KNOWN = 1_000_000
#: Bytes of a unit found by its hash; what strings collide in it by their making is far longer.
LONGEST = 255
#: Stands before a text, since no UTF-8 holds it.
HEAD = b"\xff"
MARKS = ".,;:!?"
#: Bytes of text a file.
FILE_BYTES = 16 << 20
#: Tokens in an Arrow batch that a task hands back.
BATCH_TOKENS = 1_000_000
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 20
_cuts = np.zeros(256, bool)
_cuts[[10, 32, HEAD[0]]] = True
_bytes = np.random.default_rng(20240302).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
)


class Encoder:
    """encode() of the library for whole texts, by way of distinct units.

    A unit is a word with the single space or line feed before it. The tokenizer's pattern always ends a piece
    before a lone space between two characters that aren't white space, and before and after such a line
    feed, and merges stay within pieces, so units are encoded alike alone and in place. Texts that hold the string of
    a special token are encoded as they are, since the library cuts there first.

    Most texts have no white space but lone spaces and line feeds. Their units, the first word among them, are
    found all at once: ``keys`` are sorted hashes, ``entry`` leads to where a unit's ids begin in ``flat`` and how many
    they are; ``odd`` marks units with other white space. Texts with such units, other texts and those with
    units of more than ``LONGEST`` bytes go word by word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.nul,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        (space,) = self.tokenizer.encode(" ", add_special_tokens=False).tokens
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin with a space
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.met, self.odd = np.zeros(0, bool), np.zeros(0, bool)

    def _shrink(self) -> None:
        """Keeps the units met again since the last time; all go if those are more than half of what is held."""
        kept = self.met[self.entry]
        if 2 * kept.sum() > KNOWN:
            return self._forget()
        old = self.entry[kept]
        self.keys, self.entry = self.keys[kept], np.arange(len(old), dtype=np.int32)
        self.flat = self.flat.take(ranges(self.begin[old], self.length[old]))
        self.length, self.odd = self.length[old], self.odd[old]
        self.begin = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.met = np.zeros(len(old), bool)

    def _learn_units(self, units: list[bytes]) -> np.ndarray:
        """Entries for new units, which begin with what stands before them."""
        places, sizes, begins, flats = [], [], [], []
        base, single, odd = len(self.flat), [], []

        def add(at: list[int], flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
            nonlocal base
            places.append(np.array(at, np.int64))
            begins.append(begin + base)
            sizes.append(size)
            flats.append(flat)
            base += len(flat)

        for lead, mark in ((" ", ""), ("\n", "\0")):
            own = [i for i, u in enumerate(units) if u[0] == ord(lead)]
            for some in (own[i : i + 1024] for i in range(0, len(own), 1024)):
                text = b"".join([units[i] for i in some]).decode()
                if "\0" in text or text.split() != text[1:].split(lead):
                    plain = []
                    for i in some:
                        w = units[i][1:].decode()
                        (odd if w.split() != [w] else single if "\0" in w else plain).append(i)
                    some = plain
                if some:
                    add(some, *self._flat_units([units[i].decode() for i in some], mark))
        for i, u in enumerate(units):
            if u[:1] == HEAD:
                w = u[1:].decode()
                (odd if w and w.split() != [w] else single).append(i)
        for at, ids in ((single, self._ask([units[i].removeprefix(HEAD).decode() for i in single])), (odd, [b""] * len(odd))):
            size = np.array([len(x) // 4 for x in ids], np.int64)
            add(at, np.frombuffer(b"".join(ids), np.int32), np.cumsum(size) - size, size)
        out, first = np.empty(len(units), np.int32), len(self.begin)
        out[np.concatenate(places)] = np.arange(first, first + len(units))
        self.begin = np.concatenate([self.begin, *begins]).astype(np.int32)
        self.length = np.concatenate([self.length, *sizes]).astype(np.int32)
        self.flat = np.concatenate([self.flat, *flats])
        self.met = np.append(self.met, np.zeros(len(units), bool))
        self.odd = np.append(self.odd, np.arange(len(units)) >= len(units) - len(odd))
        return out

    def _places(self, hashes: np.ndarray, unit) -> np.ndarray:
        """Entries of sorted distinct hashes; ``unit`` gives the bytes of those in some places."""
        if len(self.keys) > KNOWN:
            self._shrink()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != hashes[inside]
        fresh, out = np.flatnonzero(new), np.empty(len(hashes), np.int32)
        out[~new] = self.entry[at[~new]]
        self.met[out[~new]] = True
        if len(fresh):
            out[fresh] = self._learn_units(unit(fresh))
            self.keys = np.insert(self.keys, at[fresh], hashes[fresh])
            self.entry = np.insert(self.entry, at[fresh], out[fresh])
        return out

    def _by_units(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of the texts that have units alone, None for the others."""
        joined = HEAD + HEAD.join([t.encode() for t in texts])
        buf = np.frombuffer(joined, np.uint8)
        begin = np.flatnonzero(_cuts[buf])
        size = np.diff(begin, append=len(buf))
        end, n = begin + size, np.diff(np.flatnonzero(buf[begin] == HEAD[0]), append=len(begin))
        of = np.repeat(np.arange(len(texts)), n)
        other = np.zeros(len(texts), bool)
        other[of[(size == 1) & (n[of] > 1) | (size > LONGEST)]] = True
        for t in self.special:
            if t.encode() in joined:
                other |= np.array([t in x for x in texts])
        up, down = powers_to(len(buf) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_bytes[buf] * up[: len(buf)])])
        kept = np.flatnonzero(~other[of])
        a, b = begin[kept], end[kept]
        hashes = mix((total[b] - total[a]) * down[a] + size[kept].astype(np.uint64))
        order = hashes.argsort()
        own = hashes[order]
        cut = runs(own) if len(own) else order
        place = kept[order[cut]]
        entry = self._places(own[cut], lambda new: [joined[i:j] for i, j in zip(begin[place[new]].tolist(), end[place[new]].tolist(), strict=True)])
        entries = np.empty(len(own), np.int32)
        entries[order] = np.repeat(entry, np.diff(np.append(cut, len(own))))
        length = np.zeros(len(of), np.int64)
        length[kept] = self.length.take(entries)
        other[of[kept[self.odd.take(entries)]]] = True
        flat = self.flat.take(ranges(self.begin.take(entries), self.length.take(entries)))
        limits = [0, *np.cumsum(length)[np.cumsum(n) - 1].tolist()]
        return [None if x else flat[i:j] for x, i, j in zip(other.tolist(), limits, limits[1:])]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        found = self._by_units(texts)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self._by_words([texts[i] for i in rest]), strict=True):
            found[i] = x
        return found

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat_units(self, units: list[str], mark: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each unit's begin, how many they are) of many units in one text. With a NUL after each, which is in no merge, its id marks the ends; units that
        begin with their only space are cut before the tokens that begin with one."""
        flat = np.array(self.tokenizer.encode_batch_fast([mark.join(units) + mark], add_special_tokens=False)[0].ids, np.int32)
        if mark:
            ends = np.flatnonzero(flat == self.nul)
            begins = np.concatenate([[0], ends[:-1] + 1])
        else:
            begins = np.flatnonzero(self.leads[flat])
            ends = np.append(begins[1:], len(flat))
        return flat, begins, ends - begins

    def _ask_units(self, units: list[str], mark: str) -> list[bytes]:
        flat, begins, size = self._flat_units(units, mark)
        raw = flat.tobytes()
        return [raw[i:j] for i, j in zip((begins * 4).tolist(), ((begins + size) * 4).tolist(), strict=True)]

    def _learn(self, new: list[str], whole: bool) -> None:
        spaced, lined, odd = [], [], []
        for w in new:  # what ends in white space isn't cut alike before a NUL
            if "\0" in w or w[-1:].isspace():
                odd.append(w)
            elif w[:1] == "\n":
                lined.append(w)
            elif whole or len(w.split()) == 1:
                spaced.append(w)
            else:
                odd.append(w)
        for some in (spaced[i : i + 1024] for i in range(0, len(spaced), 1024)):
            self.cache.update(zip(some, self._ask_units([" " + w for w in some], ""), strict=True))
        for some in (lined[i : i + 1024] for i in range(0, len(lined), 1024)):
            self.cache.update(zip(some, self._ask_units(some, "\0"), strict=True))
        if odd:
            self.cache.update(zip(odd, self._ask([w if w[:1] == "\n" else " " + w for w in odd]), strict=True))

    def _add(self, parts: set[str], whole: bool) -> set[str]:
        """Puts units into the cache; with ``whole``, returns those that are none (empty, or white space inside).

        Two generations: when the younger is full it becomes the elder, and what is asked for again moves back, so
        frequent words stay and rare ones go. A letter or digit before closing marks ends a piece, so a word
        with such marks is the word and the marks.
        """
        new, tailed, bad = [], [], set()
        for w in parts:
            if (known := self.old.get(w)) is not None:
                self.cache[w] = known
                continue
            if whole and (not w or w.split() != [w[1:] if w[0] == "\n" else w]):
                bad.add(w)
                continue
            core = w.rstrip(MARKS)
            if core == w or core[-1:].isalnum() is False:
                new.append(w)
                continue
            tailed.append((w, core))
            if core not in self.cache:
                if (known := self.old.get(core)) is not None:
                    self.cache[core] = known
                else:
                    new.append(core)
        self._learn([*dict.fromkeys(new)], whole)
        for w, core in tailed:
            tail = w[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._ask([tail])[0]
            self.cache[w] = self.cache[core] + self.tails[tail]
        return bad

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, text in enumerate(texts) if any(t in text for t in self.special)]
        if whole:
            found = dict(zip(whole, self._ask([texts[i] for i in whole]), strict=True))
            rest = iter(self._by_words([t for i, t in enumerate(texts) if i not in found]))
            return [np.frombuffer(found[i], np.int32) if i in found else next(rest) for i in range(len(texts))]
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        split = [text.replace("\n", " \n").split(" ") for text in texts]
        bad = self._add({w for parts in split for w in parts[1:]}.difference(self.cache), True)
        for i, text in enumerate(texts):
            if bad and not bad.isdisjoint(split[i][1:]) or split[i][0].split() != split[i][:1]:
                split[i] = LONE_SPACE.split(text)
                self._add(set(split[i][1:]).difference(self.cache), False)
        heads = self._ask([parts[0] for parts in split]) if split else []
        return [np.frombuffer(head + b"".join(map(self.cache.__getitem__, parts[1:])), np.int32) for head, parts in zip(heads, split, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(name: str, end_id: int):
    def run(batches):
        gc.disable()  # no cycles are made here, and a full collection walks the whole cache
        own, part, start = encoder(public_tokenizers.path(name)), TaskContext.get().partitionId(), 0
        rows: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal start, rows
            n = np.array([len(x) for _, x in rows], np.int64)
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate([x for _, x in rows]).astype(np.int32)))
            out = [pa.array([d for d, _ in rows], pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), ids]
            start, rows = start + int(ends[-1]), []
            return pa.RecordBatch.from_arrays(out, names=SCHEMA.names)

        held = 0
        for b in batches:
            size, first = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()), 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + BATCH_BYTES)))
                own_rows = b.slice(first, last - first)
                first = last
                encoded = own.encode_many([t or "" for t in own_rows.column("text").to_pylist()])
                rows += [(doc, np.append(x, np.int32(end_id))) for doc, x in zip(own_rows.column("doc_id").to_pylist(), encoded, strict=True)]
                held += sum(map(len, encoded))
                if held >= BATCH_TOKENS:
                    yield flush()
                    held = 0
        if rows:
            yield flush()
        gc.enable()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encodes (doc_id, text) into a token folder, a file for each ``FILE_BYTES`` of text or, if that is fewer, one for
    each core. Texts move once, before they are encoded."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(int(files), F.asc_nulls_first("doc_id"), "h")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text")
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("compression", "snappy")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES))
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """All rows, or those of ids low to high: the filter reaches the row groups and page indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, offset): a row a file; reads no ids."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def _digest(batches):
    for b in batches:
        ids = b.column("ids")
        flat = ids.flatten().to_numpy().astype("<u4")
        ends = np.cumsum(np.concatenate([[0], ids.value_lengths().to_numpy()]))
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def op8_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    rows = read_tokens(spark, path).mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(part_offsets(spark, path)), "part").select(  # a row a file
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
