"""Approximate nearest neighbours: a forest of random-projection trees.

The forest's planes come from a bounded sample (``SAMPLE`` vectors that hash lowest); every row is indexed
with it, its leaf in each tree. A query searches all trees through one priority queue, ordered by the smallest margin on
the way, and takes leaves until they cover ``COVER`` of the sample; then all rows that lie in one of those leaves are
reranked by the exact cosine in double precision. ``COVER`` is a share, so recall does not fall as the data grows; 0.6
is set for data without any clusters, where neighbours are hardly nearer than the rest (see the README for the curve);
clustered data needs far less.

Vectors move once. A row goes with its leaves, a query with one bit for each leaf of the forest, so a row that several
trees lead to is reranked once. Rows are dealt to blocks and queries to chunks of bounded bytes, whatever their leaves, and
a task has one of each; a very common vector fills no task of its own. Each returns its own k best.

Dirty input. See ``vectors.valid`` for rows that take no part; zero vectors take none either. A vec_id on
several rows counts once with its best score and never as a partner of itself. Ties go to the smaller
vec_id. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .text import mix
from .vectors import best, matrix, sample, top_rows, unit, valid

K = 5
EVERY = 50
TREES = 16
SAMPLE = 16384
LEAF = 12
COVER = 0.6
#: Bytes of the vectors of a block of rows, and of a chunk of queries.
BLOCK_BYTES = 32 << 20
CELLS = 2 << 20


class Tree:
    """Planes in arrays; children at or above 0 are nodes, below 0 leaves (leaf number = -1 - child)."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.planes, self.offsets, self.children, self.leaves = [], [], [], []
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        self.planes = np.array(self.planes).reshape(len(self.planes), x.shape[1])
        self.offsets, self.children = np.array(self.offsets), np.array(self.children, int).reshape(-1, 2)
        self.ways = self.children.tolist()

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(at) > leaf:
            for _ in range(8):  # equal points give no plane; after a few tries this is a leaf
                a, b = x[rng.choice(at, 2, replace=False)]
                w = a - b
                if not (size := np.linalg.norm(w)):
                    continue
                p = x[at] @ (w / size)
                cut = float(np.median(p))
                if 0 < (left := p <= cut).sum() < len(at):
                    node = len(self.planes)
                    self.planes.append(w / size)
                    self.offsets.append(cut)
                    self.children.append([0, 0])
                    self.children[node] = [self._grow(x, at[left], leaf, rng), self._grow(x, at[~left], leaf, rng)]
                    return node
        self.leaves.append(at)
        return -len(self.leaves)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (go := np.flatnonzero(at >= 0)).size:
            node = at[go]
            right = np.einsum("ij,ij->i", x[go], self.planes[node]) > self.offsets[node]
            at[go] = self.children[node, right.astype(int)]
        return -1 - at


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def build(x: np.ndarray, n_trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> list[Tree]:
    return [Tree(x, leaf, np.random.default_rng([seed, t])) for t in range(n_trees)]


def search(forest: list[Tree], q: np.ndarray, most: int, n: int) -> list[tuple[int, int]]:
    """(tree, leaf) of one query: leaves in the order of the shared queue until they cover ``most`` of the n
    sampled points."""
    heap = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    margins = [(tree.planes @ q - tree.offsets).tolist() if len(tree.planes) else [] for tree in forest]
    seen, covered, out = np.zeros(n, bool), 0, []
    while heap and covered < most:
        worst, t, node = heapq.heappop(heap)
        while node >= 0:  # down to the nearest leaf; the way not taken waits in the queue
            m = margins[t][node]
            left, right = forest[t].ways[node]
            near, far = (left, right) if m <= 0 else (right, left)
            heapq.heappush(heap, (max(worst, abs(m)), t, far))
            node = near
        out.append((t, -1 - node))
        at = forest[t].leaves[-1 - node]
        covered += len(at) - int(np.count_nonzero(seen[at]))
        seen[at] = True
    return out


def _index(forest: list[Tree]):
    """Adds each row's leaves and an even number by which rows are dealt, equal rows too."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            if b.num_rows:
                u = unit_rows(matrix(b.column("v")))
                leaves = np.stack([t.leaf_of(u) for t in forest], 1).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, len(forest), dtype=np.int32)), pa.array(leaves.reshape(-1)))
                deal = mix(np.arange(at, at + b.num_rows).astype(np.uint64)) >> np.uint64(1)
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), rows, pa.array(deal.astype(np.int64))], names=["vec_id", "v", "leaves", "deal"])

    return run


def _probe(forest: list[Tree], n: int, most: int):
    """(query_id, q, leaves): a bit for every leaf of the forest, tree after tree."""
    first = np.cumsum([0, *(len(t.leaves) for t in forest)])

    def run(batches):
        for b in batches:
            if b.num_rows:
                bits = np.zeros((b.num_rows, first[-1]), bool)
                for i, q in enumerate(unit_rows(matrix(b.column("v")))):
                    found = np.array(search(forest, q, most, n)).reshape(-1, 2)
                    bits[i, first[found[:, 0]] + found[:, 1]] = True
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["query_id", "q", "leaves"])

    return run


def _rerank(k: int, sizes: list[int]):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    first = np.cumsum([0, *sizes])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if data.num_rows and queries.num_rows:
            ids, x, leaves = data.column("vec_id").to_numpy(), matrix(data.column("v")), matrix(data.column("leaves"), np.int32) + first[:-1]
            qids, q = queries.column("query_id").to_numpy(), matrix(queries.column("q"))
            packed = np.stack([np.frombuffer(r, np.uint8) for r in queries.column("leaves").to_pylist()])
            xn, qn, repeats = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1)), len(np.unique(ids)) < len(ids)
            step = max(1, CELLS // len(ids))
            for i in range(0, len(qids), step):
                part = slice(i, i + step)
                bits = np.unpackbits(packed[part], axis=1, count=first[-1]).astype(bool)
                met = np.zeros((len(bits), len(ids)), bool)
                for tree in leaves.T:
                    met |= bits[:, tree]
                s = (q[part] @ x.T) / (qn[part][:, None] * xn[None, :])
                s[~met | (qids[part][:, None] == ids[None, :])] = -np.inf
                for query, row in zip(qids[part], s, strict=True):
                    top = top_rows(ids, row, k)
                    if repeats and len(np.unique(ids[top])) < len(top):  # repeated rows of an id count once
                        order = np.lexsort((ids, -row))
                        order = order[row[order] > -np.inf]
                        top = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
                    out.append((np.full(len(top), query), ids[top], row[top]))
        if not out:
            return schema.empty_table()
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], schema=schema)

    return run


def forest_search(rows: DataFrame, query_rows: DataFrame, k: int = K, n_trees: int = TREES, n_sample: int = SAMPLE, leaf: int = LEAF, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, v) rows."""
    spark = rows.sparkSession
    ids, points = sample(rows, n_sample)
    if not len(ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = build(unit_rows(points), n_trees, leaf)
    most = math.ceil(cover * len(ids))
    index = materialize(rows.mapInArrow(_index(forest), "vec_id long, v array<double>, leaves array<int>, deal long"), "forest")
    total, cores = index.count(), spark.sparkContext.defaultParallelism
    own = block_bytes // (8 * points.shape[1])  # rows a block
    blocks = max(min(cores, math.ceil(total / 4096)), math.ceil(total / own))
    probes = materialize(query_rows.select("vec_id", "v").repartition(cores).mapInArrow(_probe(forest, len(ids), most), "query_id long, q array<double>, leaves binary"), "probes")
    chunks = max(1, math.ceil(probes.count() / own))
    data = index.withColumn("block", F.pmod("deal", F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sent = probes.withColumn("chunk", unit("query_id", "q", buckets=chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = ["block", "chunk"]
    found = data.groupBy(*pair).cogroup(sent.groupBy(*pair)).applyInArrow(_rerank(k, [len(t.leaves) for t in forest]), "query_id long, vec_id long, score double")
    return best(found, k)


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found, by cosine, of every 50th vector among all the others."""
    rows = valid(table(spark, sf_dir, "embeddings"), nonzero=True)
    return forest_search(rows, rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0))
