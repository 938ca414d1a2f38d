"""Similarity self-join of word-shingle sets: a count-vector R-tree.

A set's point counts its shingles by hash group; ``D`` groups, a power of two of at least n / 8. For two sets
the summed coordinate minima bound the overlap from above, and so do the summed minima of the upper corners of
two boxes, which lets a dual walk over an R-tree drop whole pairs of nodes. Survivors are verified on the
sets. Every link is found: the bounds only ever skip pairs that cannot link.

In 32 or more dimensions the box of unrelated points covers about everything, so one tree over a corpus would
compare all pairs. The root of the index therefore has one slab for every shingle: a set of n shingles lies in
the slabs of its first n - ceil(0.75 n) + 1 shingles in one global order. The first shingle that two linked
sets share is among those of the larger, and among the first n - ceil(6/7 n) + 1 of the smaller (its home
slabs), so a slab that is home to none is empty. The order puts long shingles first and those seen in several
texts last; it is an order whatever the counts, so counting by sample windows costs no exactness. Steps:

1. ``_marks``: each text's set size and 64-bit set signature; equal signatures are one class, copies need no
   pairs. In windows of a task, shingles of three sets or more are counted; the ``FREQUENT`` commonest go last.
2. ``_slabs``: (shingle, class, size, home) for each slab of each class. An entry needs a tree only if its slab
   has another class of a size that may link, the smaller at home. Those are marked, by shingle and size, in a
   bit table of ``FILTER_BITS`` bits, of fixed size however many they are; a wrong mark only costs.
3. ``_entries``: for the marked entries, (shingle, class, point).
4. ``_trees``: an R-tree a slab joins its points, but for slabs of a few; pairs that the bound lets pass are united, and a class is
   sent on with the group of its task, not with its pairs. Groups that meet over slabs are joined into blocks, whose
   classes are marked in a bit table likewise.
5. ``_solve``: a block's sets, made once more from the texts, meet once. An R-tree over them, then verification,
   nearest first, skipping pairs that are connected already. A block beyond ``TILE`` sets is solved in tiles, then among one set of each tile
   group, ``PART`` of them at a time, then each ``PART`` of what is still apart is checked against ``SPAN`` tiles at a time, so that no task holds a hot block.

Rows that move: a quarter of all shingles at 16 bytes in step 2, the points of texts that share a rare
shingle, and the sets of texts in blocks. Hashing a text again costs less than moving its set. No pair is emitted before it is verified, and of a hot group not all pairs are.

Dirty input. Null and empty texts and texts without words have an empty set and link with nothing, equal or
not; their component is their own id. Fewer words than five make one shingle. Repeated rows and equal sets are
one class and linked. Null ids keep a row; a class with null ids alone has a null component. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import commonest, materialize, shuffles_freed, table
from .components import components
from .text import chunked, groups, mix, shingle_sets

THRESHOLD = 75
FREQUENT = 1 << 19
WINDOW = 3_000_000
FILTER_BITS = 1 << 27
CLASS_BITS = 1 << 26
#: The bits of a shingle by which slabs are counted; two that agree in them are taken for shared, which only costs.
SLAB = np.uint64((1 << 40) - 1)
BLOCK_BITS = 1 << 20
TILE = 96
PART = 16 * TILE
LEAF = 8
#: Tiles that a part of what is still apart meets at once.
SPAN = 4
#: Most bytes of the bit rows by which sets that meet are verified.
ROWS_BYTES = 64 << 20
#: Points of a slab up to which its pairs are told without a tree.
FEW = 16


def bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def signature(s: np.ndarray) -> int:
    """64 bits of a set, as a signed long."""
    total = mix(s).sum(keepdims=True, dtype=np.uint64) + np.bitwise_xor.reduce(s, keepdims=True) * np.uint64(0xD6E8FEB86659FD93)
    return int(mix(total + np.uint64(len(s))).view(np.int64)[0])


def point(s: np.ndarray) -> np.ndarray:
    """Counts by hash group; groups double until every count fits a byte."""
    bits = max(5, int(np.ceil(np.log2(max(1, len(s)) / 8))))
    while True:
        counts = np.bincount(groups(s, bits), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        bits += 1


def fold(p: np.ndarray, dims: int) -> np.ndarray:
    """The point with fewer groups; neighbours share their leading hash bits."""
    return p.astype(np.uint16).reshape(dims, -1).sum(1, dtype=np.uint16) if len(p) > dims else p.astype(np.uint16)


def packed(p: np.ndarray) -> bytes:
    """A point's bytes, two counts in one where all are below 16."""
    return b"\1" + (p[::2] << 4 | p[1::2]).tobytes() if p.max() < 16 else b"\0" + p.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    p = np.frombuffer(raw, np.uint8)[1:]
    return np.stack([p >> 4, p & 15], 1).reshape(-1) if raw[0] else p


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


class RTree:
    """Bulk-loaded over count points: split at the median of the widest coordinate. A node keeps the upper
    corner of its box and its least and largest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes, self.leaf = points, sizes, leaf
        self.root = self._node(np.arange(len(points)))

    def _node(self, at: np.ndarray) -> tuple:
        own, n = self.points[at], self.sizes[at]
        head = (own.max(0), int(n.min()), int(n.max()), at)
        if len(at) <= self.leaf:
            return (*head, None)
        d = int((own.max(0) - own.min(0)).argmax())
        order = at[np.lexsort((n, own[:, d]))]
        return (*head, (self._node(order[: len(at) // 2]), self._node(order[len(at) // 2 :])))

    def pairs(self, t: int, label: np.ndarray | None = None, probes: np.ndarray | None = None, met: np.ndarray | None = None):
        """(i array, j array, bound array) of pairs that may link, leaf pair by leaf pair. ``label``, which the caller may change
        meanwhile: nodes whose points all have one label are passed by. ``probes`` and ``met``: only pairs of one with the other."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if 100 * a[2] < t * b[1] or 100 * b[2] < t * a[1]:
                continue
            if label is not None and (label[a[3]] == label[b[3][0]]).all() and (label[b[3]] == label[a[3][0]]).all():
                continue
            if probes is not None and not (probes[a[3]].any() and met[b[3]].any() or met[a[3]].any() and probes[b[3]].any()):
                continue
            if a is not b and (100 + t) * int(np.minimum(a[0], b[0]).sum(dtype=np.int64)) < t * (a[1] + b[1]):
                continue
            if a[4] is None and b[4] is None:
                i, j = (x.ravel() for x in np.meshgrid(a[3], b[3], indexing="ij"))
                if a is b:
                    i, j = i[i < j], j[i < j]
                small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
                ok = 100 * small >= t * large
                if label is not None:
                    ok &= label[i] != label[j]
                if probes is not None:
                    ok &= probes[i] & met[j] | met[i] & probes[j]
                i, j = i[ok], j[ok]
                if len(i):
                    bound = np.minimum(self.points[i], self.points[j]).sum(1, dtype=np.int64)
                    ok = (100 + t) * bound >= t * (self.sizes[i] + self.sizes[j])
                    if ok.any():
                        yield i[ok], j[ok], bound[ok]
                continue
            if a is b:
                left, right = a[4]
                stack += [(left, right), (left, left), (right, right)]
            elif b[4] is None or a[4] is not None and len(a[3]) >= len(b[3]):
                stack += [(x, b) for x in a[4]]
            else:
                stack += [(a, x) for x in b[4]]


def may_link(points: list[np.ndarray], sizes: np.ndarray, t: int) -> Union:
    """Unites all members of a slab between which the bound leaves a link possible."""
    found, label = Union(len(points)), np.arange(len(points))
    dims = np.array([len(p) for p in points])
    for d in np.unique(dims):
        # sets of the next size class meet this one only near its upper end; other classes are too far in size
        at = np.flatnonzero((dims == d) | (dims > d) & (t * sizes <= 100 * sizes[dims == d].max()))
        if len(at) > 1:
            own = label[at]
            for i, j, _ in RTree(np.stack([fold(points[k], int(d)) for k in at]), sizes[at]).pairs(t, own):
                while len(i):  # most pairs of near copies are together already
                    x, y = own[i], own[j]
                    apart = x != y
                    i, j = i[apart], j[apart]
                    if len(i):
                        x, y = int(x[apart][0]), int(y[apart][0])
                        found.join(x, y)
                        own[own == max(x, y)] = min(x, y)
            label = np.array([found.root(k) for k in range(len(points))])
    return found


class Overlaps:
    """Shingles that pairs of sets share. Those that several sets have are bits of a row for each set, if all rows together take
    no more than ``ROWS_BYTES``; else, and for a few sets, each pair of sets is intersected."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.rows = sets, None
        if len(sets) > FEW:
            values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            place = np.cumsum(times > 1) - 1
            words = -(-max(1, int((times > 1).sum())) // 64)
            if words * 8 * len(sets) <= ROWS_BYTES:
                who, shared = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), times[at] > 1
                who, bit = who[shared], place[at[shared]]
                self.rows = np.zeros((len(sets), words), np.uint64)
                np.add.at(self.rows.reshape(-1), who * words + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))  # no bit comes twice

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.rows is not None:
            return np.bitwise_count(self.rows[i] & self.rows[j]).sum(1, dtype=np.int64)
        return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)


def links(sets: list[np.ndarray], t: int, known: list[int] | None = None, probes: np.ndarray | None = None, met: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that connect what is linked; of pairs connected already none. ``known``: groups
    connected before. ``probes``: only pairs of one of these with one of ``met`` (None: any)."""
    sizes = np.array([len(s) for s in sets])
    label, out = np.arange(len(sets)), []
    if known is not None:
        first: dict[int, int] = {}
        label = np.array([first.setdefault(g, i) for i, g in enumerate(known)])
    if probes is not None and met is None:
        met = np.ones(len(sets), bool)
    bits = max(5, min(10, int(np.ceil(np.log2(max(1, sizes.max()) / 8)))))
    points = np.stack([np.bincount(groups(s, bits), minlength=1 << bits) for s in sets]).astype(np.uint32)
    shared = Overlaps(sets)
    for i, j, bound in RTree(points, sizes).pairs(t, label, probes, met):
        nearest = np.argsort(-bound, kind="stable")
        i, j = i[nearest], j[nearest]
        step = 1 if shared.rows is None else len(i)
        while len(i):
            x, y = i[:step], j[:step]
            ok = (100 + t) * shared.of(x, y) >= t * (sizes[x] + sizes[y])
            for x, y in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if label[x] != label[y]:
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
                    out.append((x, y))
            i, j = i[step:], j[step:]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    return out


def _marks(batches):
    """kind 0: (doc_id, row, n, class); kind 1: (shingle as class, sets in the window as n)."""
    names = ["kind", "doc_id", "row", "n", "class"]
    window: dict[int, np.ndarray] = {}
    held = 0

    def counted():
        v, c = np.unique(np.concatenate([*window.values()]), return_counts=True)
        v, c = v[c >= 3], c[c >= 3]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(v), np.int32)), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.int64()), pa.array(c.astype(np.int64)), pa.array(v.view(np.int64))], names=names)

    for b in batches:
        for rows in chunked(zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), bytes_of(b.column("bytes")), strict=True)):
            sets = shingle_sets([r[2] for r in rows])
            sig = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(rows), np.int32)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.int64())], names=names
            )
            for g, s in zip(sig, sets, strict=True):
                if g is not None and g not in window:
                    window[g] = s
                    held += len(s)
            if held >= WINDOW:
                yield counted()
                window, held = {}, 0
    if window:
        yield counted()


class Order:
    """The global order of shingles: those in no list of frequent ones by hash, then those by their count."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        by = np.argsort(h)
        self.frequent, self.rank = h[by], n[by]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray, t: int) -> np.ndarray:
        """The slabs of a set: its first shingles."""
        n = len(s)
        p = n - -(-t * n // 100) + 1
        common = self.maybe[(s & np.uint64((1 << 22) - 1)).astype(np.int64)]
        which = np.flatnonzero(common)
        if len(which):
            at = np.searchsorted(self.frequent, s[which])
            at[at == len(self.frequent)] = 0
            hit = self.frequent[at] == s[which]
            common[which[~hit]] = False
            at = at[hit]
        rare = s[~common]
        if len(rare) >= p:
            return rare[:p]
        return np.concatenate([rare, s[common][np.argsort(self.rank[at], kind="stable")][: p - len(rare)]])


def _slabs(frequent, t: int):
    def run(batches):
        order = frequent.value
        for b in batches:
            for rows in chunked((x,) for x in bytes_of(b.column("bytes"))):
                own = {signature(s): s for s in shingle_sets([r[0] for r in rows]) if len(s)}
                if own:
                    p = [order.prefix(s, t) for s in own.values()]
                    home = [np.arange(len(x)) <= len(s) - -(-2 * t * len(s) // (100 + t)) for x, s in zip(p, own.values(), strict=True)]
                    n = np.repeat([len(s) for s in own.values()], [len(x) for x in p])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((np.concatenate(p) & SLAB).view(np.int64)), pa.array(np.repeat(np.array([*own], np.int64), [len(x) for x in p])), pa.array((2 * n + np.concatenate(home)).astype(np.int32))], names=["h", "class", "nh"]
                    )

    return run


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return mix(h.view(np.uint64)) & np.uint64(bits - 1)


def _positions(h: np.ndarray, bits: int) -> pa.RecordBatch:
    at = np.unique(_place(h, bits)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array((at // BLOCK_BITS).astype(np.int32)), pa.array((at % BLOCK_BITS).astype(np.int32))], names=["block", "bit"])


def _key(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A slab's sets of about one size."""
    return mix(h.view(np.uint64) & SLAB) + np.floor(np.log(n) * 4).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _shared(bits: int, t: int):
    """Of a partition of (h, class, nh), nh twice the size and 1 for a home: where in the bit table the entries
    are that may link with another of their slab. In a slab in order of size, homes first among equals, a home
    that has a larger partner has one in the next entry; whoever has a smaller partner, which must be at home,
    has one in the last home before it, however many entries stand between."""

    def run(batches):
        cols = [(b.column("h").to_numpy(), b.column("class").to_numpy(), b.column("nh").to_numpy()) for b in batches if b.num_rows]
        if cols:
            h, c, nh = (np.concatenate(x) for x in zip(*cols, strict=True))
            order = np.argsort(h, kind="stable")
            again = h[order[1:]] == h[order[:-1]]
            order = order[np.concatenate([again, [False]]) | np.concatenate([[False], again])]  # slabs of one row go
            order = order[np.lexsort((c[order], nh[order] ^ 1, h[order]))]
            h, c, nh = h[order], c[order], nh[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])  # a class sent by several tasks counts once
            h, n, home = h[first], (nh // 2)[first], (nh % 2 == 1)[first]
            last = np.maximum.accumulate(np.where(home, np.arange(len(h)), 0))[:-1]  # where none is, home[0] or h tells
            smaller = home[last] & (h[last] == h[1:]) & (100 * n[last] >= t * n[1:])
            larger = home[:-1] & (h[1:] == h[:-1]) & (100 * n[:-1] >= t * n[1:])
            may = np.concatenate([larger, [False]]) | np.concatenate([[False], smaller])
            yield _positions(_key(h[may], n[may]), bits)

    return run


def _marked(bits: int):
    def run(batches):
        for b in batches:
            yield _positions(b.column("class").to_numpy(), bits)

    return run


def _bitmap(t: pa.Table) -> pa.Table:
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[t.column("bit").to_numpy()] = 1
    return pa.table({"block": t.column("block")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bit_table(positions: DataFrame, n: int):
    """A broadcast table of n bits, whatever the number of positions."""
    with shuffles_freed(positions.sparkSession):
        maps = positions.groupBy("block").applyInArrow(_bitmap, "block int, bits binary").toArrow()
    bits = np.zeros(n // 8, np.uint8)
    for block, raw in zip(maps.column("block").to_pylist(), maps.column("bits"), strict=True):
        bits[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = np.frombuffer(raw.as_buffer(), np.uint8)
    return positions.sparkSession.sparkContext.broadcast(bits)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h, len(bits) * 8)
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _classes(batches):
    """{class: set} of about a megabyte of texts after another."""
    for b in batches:
        for rows in chunked((x,) for x in bytes_of(b.column("bytes"))):
            yield {signature(s): s for s in shingle_sets([r[0] for r in rows]) if len(s)}


def _entries(frequent, marked, t: int):
    """(h, class, point) of marked slabs."""

    def run(batches):
        order, bits = frequent.value, marked.value
        for own in _classes(batches):
            p = [x[_in(bits, _key(x, np.full(len(x), len(s))))] for x, s in ((order.prefix(s, t), s) for s in own.values())]
            n = np.array([len(x) for x in p])
            if n.sum():
                points = pa.array([packed(point(s)) if k else b"" for s, k in zip(own.values(), n, strict=True)], pa.binary())
                at = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).view(np.int64)), pa.array(np.array([*own], np.int64)[at]), points.take(pa.array(at))], names=["h", "class", "body"])

    return run


def _sets(marked):
    """(class, whole set) of marked classes."""

    def run(batches):
        for own in _classes(batches):
            keys = np.array([*own], np.int64)
            keys = keys[_in(marked.value, keys)].tolist()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([own[k].tobytes() for k in keys], pa.binary())], names=["class", "body"])

    return run


def _points(raw: list[bytes]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """({groups: points of so many groups as rows}, groups of each, its row, its size)."""
    form: dict[tuple[int, int], list[int]] = {}
    for k, p in enumerate(raw):
        form.setdefault((len(p), p[0]), []).append(k)
    parts: dict[int, list[np.ndarray]] = {}
    dims, place, sizes = (np.empty(len(raw), np.int64) for _ in range(3))
    for (n, two), at in form.items():
        m = np.frombuffer(b"".join([raw[k] for k in at]), np.uint8).reshape(-1, n)[:, 1:]
        m = np.stack([m >> 4, m & 15], 2).reshape(len(at), -1) if two else m
        own = parts.setdefault(m.shape[1], [])
        dims[at], place[at], sizes[at] = m.shape[1], sum(map(len, own)) + np.arange(len(at)), m.sum(1, dtype=np.int64)
        own.append(m)
    return {d: np.concatenate(x) for d, x in parts.items()}, dims, place, sizes


def may_pair(raw: list[bytes], a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Which pairs of packed points the bound lets pass, pairs of equal numbers of groups at once."""
    tables, dims, place, sizes = _points(raw)
    passed = 100 * np.minimum(sizes[a], sizes[b]) >= t * np.maximum(sizes[a], sizes[b])
    left = np.flatnonzero(passed)
    shape = dims[a[left]] << 32 | dims[b[left]]
    for s in np.unique(shape).tolist():
        own, few = left[shape == s], min(s >> 32, s & 0xFFFFFFFF)
        step = max(1, (1 << 21) // max(s >> 32, s & 0xFFFFFFFF))
        for at in (own[i : i + step] for i in range(0, len(own), step)):
            p, q = (tables[d][place[x[at]]] for d, x in ((s >> 32, a), (s & 0xFFFFFFFF, b)))
            p, q = (m if m.shape[1] == few else m.reshape(len(m), few, -1).sum(2, dtype=np.uint16) for m in (p, q))
            passed[at] = (100 + t) * np.minimum(p, q).sum(1, dtype=np.int64) >= t * (sizes[a[at]] + sizes[b[at]])
    return passed


def _trees(t: int):
    """Of a partition of slab entries: (a, b) that keep together what may link. Pairs of slabs of up to ``FEW`` points are told once each,
    however many slabs they share; a larger slab needs a tree if its points are not all together by then."""

    def run(batches):
        cols = [(b.column("h").to_numpy(), b.column("class").to_numpy(), b.column("body").to_pylist()) for b in batches if b.num_rows]
        if not cols:
            return
        h, c, body = np.concatenate([x[0] for x in cols]), np.concatenate([x[1] for x in cols]), [p for x in cols for p in x[2]]
        order = np.lexsort((c, h))
        order = order[np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)])]
        classes, first, which = np.unique(c[order], return_index=True, return_inverse=True)
        raw = [body[k] for k in order[first].tolist()]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        n = np.diff(begin, append=len(order))
        codes = [np.zeros(0, np.int64)]
        for k in range(2, FEW + 1):
            members = which[begin[n == k][:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            codes.append(np.unique(members[:, i] * len(classes) + members[:, j]))
        a, b = np.divmod(np.unique(np.concatenate(codes)), len(classes))
        passed, found = may_pair(raw, a, b, t), Union(len(classes))
        for x, y in zip(a[passed].tolist(), b[passed].tolist(), strict=True):
            found.join(x, y)
        seen = set()
        for s in np.flatnonzero(n > FEW).tolist():
            own = which[begin[s] : begin[s] + n[s]]
            key, at = own.tobytes(), own.tolist()
            if key in seen or len({found.root(x) for x in at}) == 1:  # near copies share many slabs
                continue
            seen.add(key)
            points = [unpacked(raw[x]) for x in at]
            near = may_link(points, np.array([int(p.sum(dtype=np.int64)) for p in points]), t)
            for k, x in enumerate(at):
                found.join(at[near.root(k)], x)
        roots = np.array([found.root(k) for k in range(len(classes))])
        moved = np.flatnonzero(roots != np.arange(len(classes)))
        yield pa.RecordBatch.from_arrays([pa.array(classes[roots[moved]]), pa.array(classes[moved])], names=["a", "b"])

    return run


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _solve(t: int):
    """Links inside each (block, tile) of a bucket; with ``known`` labels, ``probe`` and ``met`` flags, only what is
    still apart and is a probe and one that it meets."""

    def run(rows: pa.Table) -> pa.Table:
        block, tile, cls = (rows.column(x).to_numpy() for x in ("block", "tile", "class"))
        known, body = rows.column("known").to_numpy(), rows.column("body").to_pylist()
        probe, met = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("probe", "met"))
        order = np.lexsort((cls, ~probe, tile, block))
        out = []
        for at in np.split(order, np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(tile[order]) != 0)) + 1):
            once = {int(cls[k]): k for k in reversed(at.tolist())}  # a set may be a probe and met, in two rows
            asked, seen = set(cls[at[probe[at]]].tolist()), set(cls[at[met[at]]].tolist())
            flags = [np.array([c in x for c in once]) for x in (asked, seen)]
            at = [*once.values()]
            for i, j in links([np.frombuffer(body[k], np.uint64) for k in at], t, [int(known[k]) for k in at], *flags) if len(at) > 1 else ():
                out.append((int(cls[at[i]]), int(cls[at[j]])))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=EDGE)

    return run


def solved(rows: DataFrame, t: int, buckets: int) -> DataFrame:
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("block", "tile"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(_solve(t), "a long, b long")


def parted(rows: DataFrame) -> DataFrame:
    """(block, parts): into how many parts of some ``PART`` sets those of each block go."""
    return rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))


def similar_classes(docs: DataFrame, text_col: str = "text", t: int = THRESHOLD, id_col: str = "doc_id", row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row, n, class) of every row, links (a, b) between classes that connect all that is linked)."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(None).cast("long") if row is None else row).alias("row"), F.col(text_col).cast("binary").alias("bytes"))
    marks = materialize(texts.mapInArrow(_marks, "kind int, doc_id long, row long, n long, class long"), "marks")
    common = marks.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n"))
    common = commonest(common, "n", FREQUENT).toArrow()
    frequent = sc.broadcast(Order(common.column("class").to_numpy().view(np.uint64), common.column("n").to_numpy()))  # FREQUENT entries at most

    slabs = texts.select("bytes").mapInArrow(_slabs(frequent, t), "h long, class long, nh int").repartition("h")
    marked = bit_table(slabs.mapInArrow(_shared(FILTER_BITS, t), "block int, bit int"), FILTER_BITS)
    entries = texts.select("bytes").mapInArrow(_entries(frequent, marked, t), "h long, class long, body binary")
    united = materialize(entries.repartition("h").mapInArrow(_trees(t), "a long, b long"), "groups")
    frequent.unpersist()
    marked.unpersist()
    blocks = components(united).withColumnsRenamed({"node": "class", "label": "block"})

    size = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size")).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    placed = blocks.join(size, "block").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    wanted = bit_table(blocks.select("class").mapInArrow(_marked(CLASS_BITS), "block int, bit int"), CLASS_BITS)
    sets = texts.select("bytes").mapInArrow(_sets(wanted), "class long, body binary")
    held = materialize(
        sets.join(placed, "class").select("block", "tile", "tiles", "class", "body", F.col("class").alias("known"), F.lit(True).alias("probe"), F.lit(True).alias("met")), "blocks"
    )
    wanted.unpersist()
    count = size.agg(F.coalesce(F.sum("tiles"), F.lit(0))).collect()[0][0]
    buckets = max(8, int(count) // 64)
    shape = ["block", "tile", "class", "body", "known", "probe", "met"]
    first = materialize(solved(held.select(*shape), t, buckets), "links")

    tiled = held.where("tiles > 1").drop("known", "probe", "met")
    if not tiled.limit(1).count():
        return marks.where("kind = 0").drop("kind"), first
    label = components(first)
    named = tiled.join(label, tiled["class"] == label["node"], "left").select(*tiled.columns, F.coalesce("label", "class").alias("known"))
    leaders = named.where("known = class").drop("known", "tile", "tiles")
    leaders = leaders.join(parted(leaders), "block").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    leaders = leaders.select("block", "tile", "class", "body", F.col("class").alias("known"), F.lit(True).alias("probe"), F.lit(True).alias("met"))
    second = materialize(first.unionByName(solved(leaders, t, buckets)), "links")

    label = components(second)
    named = tiled.join(label, tiled["class"] == label["node"], "left").select(*tiled.columns, F.coalesce("label", "class").alias("known"))
    per = named.groupBy("block", "known").agg(F.count(F.lit(1)).alias("n"))
    largest = per.groupBy("block").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    named = materialize(named.join(largest, "block").withColumn("probe", F.col("known") != F.col("main")).drop("main"), "named")
    apart = named.where("probe")
    apart = apart.join(parted(apart), "block").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    every = lambda n: F.sequence(F.lit(0), (F.col(n) if isinstance(n, str) else n).cast("int") - 1)
    place = (F.col("tile") * F.col("parts") + F.col("part")).alias("tile")  # a span of tiles' sets and a part of what is apart
    asked = apart.drop("tile").withColumn("tile", F.explode(every(F.ceil(F.col("tiles") / SPAN)))).withColumn("met", F.lit(False))
    met = named.withColumn("tile", F.floor(F.col("tile") / SPAN).cast("int")).join(apart.select("block", "parts").distinct(), "block")
    met = met.withColumn("part", F.explode(every("parts"))).withColumn("probe", F.lit(False)).withColumn("met", F.lit(True))
    shape_ = ["block", place, "class", "body", "known", "probe", "met"]
    third = solved(asked.select(*shape_).unionByName(met.select(*shape_)), t, buckets)
    return marks.where("kind = 0").drop("kind"), materialize(second.unionByName(third), "links")


def near_groups(docs: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) of every row."""
    marks, found = similar_classes(docs, t=t)
    label = components(found)
    per = marks.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"))
    per = per.join(label, per["class"] == label["node"], "left").select("class", "low", F.coalesce("label", "class").alias("label"))
    lowest = per.groupBy("label").agg(F.min("low").alias("component_id"))
    of = per.join(lowest, "label").select("class", "component_id")
    found = marks.where("class is not null").join(of, "class").select("doc_id", F.col("n").alias("n_shingles"), "class", "component_id")
    alone = marks.where("class is null").select("doc_id", F.col("n").alias("n_shingles"), "class", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def op6_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group one row stays, that with the smallest doc_id, null ids last; of
    several such the lowest hash of all columns, and of rows equal in all columns one. Rows without any shingle
    all stay."""
    row, empty, nth = "codestrata_row", "codestrata_empty", "codestrata_nth"
    key = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    marks, found = similar_classes(docs, row=key)
    label = components(found)
    sets = marks.where("class is not null")
    per = sets.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    per = per.join(label, per["class"] == label["node"], "left").select("first", F.coalesce("label", "class").alias("label"))
    chosen = per.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row), F.lit(False).alias(empty))
    chosen = chosen.unionByName(marks.where("class is null").select(F.col("row").alias(row), F.lit(True).alias(empty)).distinct())
    kept = docs.withColumn(row, key).join(chosen, row)
    if sets.groupBy("row").count().where("count > 1").limit(1).count():
        kept = kept.withColumn(nth, F.when(F.col(empty), F.monotonically_increasing_id())).dropDuplicates([row, nth])
    return kept.select(*docs.columns)
