"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

A text is its lower-cased words and an end. A word's subwords are the ids that a public byte-level BPE gives it
with a space before it, so the subwords of a text spell its words and nothing else. The model is one causal attention
head over subword ids, with learned embeddings of every id and learned positions, plus a term for the last id alone. Its
output layer is a binary tree over all ids, built by their counts over all training texts: p(id) is a product of
decisions on the way to it, some 8 of them instead of a sum over 50,000 ids. The first decision is whether a word
begins, so the model gives a probability to whole words: their ids, and that the word ends there.

Training. Each round sends the weights to the executors; every task trains on its own training texts, whole ones of
any length, by Adagrad steps over batches of ``TRAIN_WINDOWS`` windows, and sends back how far each row of weights moved
and how often it was met; the mean by those numbers makes the next weights. Every window of every training text trains,
once: a text's checksum says in which of the rounds.

A text is scored whole, in windows of ``SPAN`` ids of which the last ``STRIDE`` are scored, so windows overlap and
every id is scored once. Windows of many texts make one batch; a mask hides what follows an id and other texts.

The score of a word mixes three shares: the attention model's, that of the word among all training words (with
``DISCOUNT`` off each count, which goes to the attention model), and that of a copying head, which attends alike to all earlier words of the
text. Each is a distribution over all words and the end, so the score is one too.

The base score and the second share need a count for every word of every text. Words are 64-bit hashes; the ``COMMON``
commonest are broadcast, a list of fixed size, and the others, a small share of the running words, are joined to
their counts by a shuffle. Text rows with equal words have one key, whose rare words are summed once.

Dirty input. Null text counts as empty: an end alone. Null ids are never held out, so they train. Repeated rows
are scored each and train each. Without training rows every count is 0 and the model is uniform over subwords.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import gc
import zlib
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import commonest, materialize, table
from .text import chunked, hashed_words, mix, word_hashes

TOKENIZER = "byte_bpe_50k.tiktoken"
VOCABULARY = 50257
END = 50256
WIDTH = 16
STRIDE = 16
SPAN = 32
ROUNDS = 2
TRAIN_WINDOWS = 128
SCORE_WINDOWS = 192
#: Nodes of the tree, the heaviest ones, whose decisions come from one product for all of them.
TOP = 64
RATE = 0.2
DISCOUNT = 0.75
MEMORY = 0.25
COPY = 0.2
#: Words after which the copying head has half its weight.
COPY_AFTER = 100
#: Rows of weights in a message.
BLOCK_ROWS = 2048
COMMON = 1 << 20
CHUNK_BYTES = 1 << 20
CACHE = 450_000
#: Words of which a task keeps counts before it sends them on.
HELD_WORDS = 2_000_000
END_WORD = np.uint64(0x5EED0E2D)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Subwords:
    """uint16 ids of words. Words are known by their hashes: ``keys`` are sorted, ``entry`` leads to where a word's ids
    begin in ``flat`` and how many they are. Entry 0 is the end of a text. At more than ``CACHE`` words those not met
    again since the last time are forgotten, or all, if they are few."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(VOCABULARY, bool)  # ids that begin with a space, so begin a word
        self.starts[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.starts[END] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.length, self.met = np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(1, bool)
        self.flat = np.array([END], np.uint16)

    def _shrink(self) -> None:
        kept = self.met[self.entry]
        if 2 * kept.sum() > CACHE:
            return self._forget()
        old = np.append(np.int32(0), self.entry[kept])
        self.keys, self.entry = self.keys[kept], np.arange(1, len(old), dtype=np.int32)
        self.flat = self.flat.take(ranges(self.begin[old], self.length[old]))
        self.length = self.length[old]
        self.begin = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.met = np.zeros(len(old), bool)

    def _ask(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 1024):  # many at once: pieces never reach over a lone space
            text = b" ".join([b"", *words[i : i + 1024]]).translate(LOWER).decode("utf-8", "replace")
            if text.split() == text[1:].split(" "):
                ids = self._ask(text)
                begin = np.flatnonzero(self.starts[ids])
            else:  # white space of other kinds in a word
                parts = [self._ask(" " + w) for w in text[1:].split(" ")]
                ids, n = np.concatenate(parts), np.array([len(x) for x in parts])
                begin = np.cumsum(n) - n
            self.begin = np.append(self.begin, (begin + len(self.flat)).astype(np.int32))
            self.length = np.append(self.length, np.diff(begin, append=len(ids)).astype(np.int32))
            self.flat = np.append(self.flat, ids)

    def _places(self, hashes: np.ndarray, word) -> np.ndarray:
        """Entries of sorted distinct hashes; ``word`` gives the bytes of those in some places."""
        if len(self.keys) > CACHE:
            self._shrink()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != hashes[inside]
        fresh = np.flatnonzero(new)
        out, first = np.empty(len(hashes), np.int32), len(self.begin)
        out[~new] = self.entry[at[~new]]
        self.met[out[~new]] = True
        if len(fresh):
            out[fresh] = np.arange(first, first + len(fresh))
            self._learn(word(fresh))
            self.met = np.append(self.met, np.zeros(len(fresh), bool))
            place = at[fresh] + np.arange(len(fresh))
            old = np.ones(len(self.keys) + len(fresh), bool)
            old[place] = False
            for name, values in (("keys", hashes), ("entry", out)):
                both = np.empty(len(old), values.dtype)
                both[place], both[old] = values[fresh], getattr(self, name)
                setattr(self, name, both)
        return out

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(ids of each text, distinct hashes of all words, place of each word in them, words of each text)."""
        hashes, n, begin, end = hashed_words(texts)
        order = hashes.argsort()
        own = hashes[order]
        cut = runs(own) if len(own) else order
        distinct, first, joined = own[cut], order[cut], b" ".join([*texts, b""])
        entry = self._places(distinct, lambda new: [joined[a:b] for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        which = np.empty(len(own), np.int32)
        which[order] = np.repeat(np.arange(len(cut), dtype=np.int32), np.diff(np.append(cut, len(own))))
        all_entries = np.zeros(len(own) + len(texts), np.int32)
        all_entries[np.arange(len(own)) + np.repeat(np.arange(len(texts)), n)] = entry[which]
        size = self.length[all_entries]
        raw = self.flat.take(ranges(self.begin[all_entries], size)).tobytes()
        limits = [0, *(2 * np.cumsum(size)[np.cumsum(n + 1) - 1]).tolist()]
        return [raw[a:b] for a, b in zip(limits, limits[1:])], distinct, which, n


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ..., n of them, for each pair, n at least 1."""
    at = np.repeat(begin - (np.cumsum(n, dtype=begin.dtype) - n), n)
    at += np.arange(len(at), dtype=begin.dtype)
    return at


def runs(order: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))


_subwords: dict[str, Subwords] = {}


def subwords(name: str = TOKENIZER) -> Subwords:
    if name not in _subwords:
        _subwords[name] = Subwords(public_tokenizers.path(name))
    return _subwords[name]


class Tree:
    """A binary tree over ids by their counts (Huffman), its root between ids that begin a word and all others.

    ``nodes`` and ``signs`` hold, id after id, the inner nodes on the way from the root and the turns taken there, 1
    for the second child; ``bias`` the log odds of that turn by the counts. The heavier a node, the lower its number."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        n = len(counts)
        up, turn, weight, top = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), np.zeros(2 * n - 1), n
        weight[:n] = counts + 0.5

        def merge(a: int, b: int) -> int:
            nonlocal top
            weight[top], up[a], up[b], turn[b] = weight[a] + weight[b], top, top, 1
            top += 1
            return top - 1

        halves = []
        for own in (np.flatnonzero(~starts), np.flatnonzero(starts)):
            leaves, merged, i, j = own[np.argsort(weight[own], kind="stable")].tolist(), [], 0, 0
            for _ in range(len(leaves) - 1):
                pair = []
                for _ in range(2):
                    if j < len(merged) and (i >= len(leaves) or weight[merged[j]] < weight[leaves[i]]):
                        pair.append(merged[j])
                        j += 1
                    else:
                        pair.append(leaves[i])
                        i += 1
                merged.append(merge(*pair))
            halves.append(merged[-1] if merged else leaves[0])
        root = merge(*halves)
        number = np.zeros(2 * n - 1, np.int64)
        number[n + np.argsort(-weight[n:], kind="stable")] = np.arange(n - 1)
        depth = np.zeros(2 * n - 1, np.int64)
        for k in range(root - 1, -1, -1):
            depth[k] = depth[up[k]] + 1
        self.length = depth[:n].astype(np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.nodes, self.signs = np.zeros(self.length.sum(), np.int32), np.zeros(self.length.sum(), np.float32)
        at, place, live = np.arange(n), self.start + self.length - 1, np.arange(n)
        while len(live):
            self.nodes[place[live]] = number[up[at[live]]]
            self.signs[place[live]] = 2 * turn[at[live]] - 1
            at[live] = up[at[live]]
            place[live] -= 1
            live = live[at[live] != root]
        sides = np.zeros((n - 1, 2))
        sides[number[up[:-1]], turn[:-1]] = weight[:-1]
        self.bias = np.log(sides[:, 1] / sides[:, 0]).astype(np.float32)
        self.split: dict[int, tuple[np.ndarray, ...]] = {}

    def ways(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """On the way to each id, of the nodes below ``top``, which come first, and of the others: how many they are and
        where they begin (four numbers an id); their codes, twice the node, plus 1 if the second turn is taken there."""
        if top not in self.split:
            upper = self.nodes < top
            high = np.add.reduceat(upper, self.start, dtype=np.int32)
            low = self.length - high
            code = 2 * self.nodes + (self.signs > 0)
            where = np.stack([high, np.cumsum(high) - high, low, np.cumsum(low) - low], 1).astype(np.int32)
            self.split[top] = where, code[upper].astype(np.uint8 if top <= 128 else np.int32), code[~upper].astype(np.int32)
        return self.split[top]


def blocks(m: np.ndarray) -> np.ndarray:
    """Rows as (blocks, rows of one, width), small enough that no library starts threads for a product of one."""
    return m.reshape(-1, STRIDE if len(m) % 128 else 128, m.shape[1])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values below 2**16, place of each value in them)."""
    if len(values) > 1 << 15:
        seen, place = np.zeros(1 << 16, bool), np.empty(1 << 16, np.int64)
        seen[values] = True
        found = np.flatnonzero(seen)
        place[found] = np.arange(len(found))
        return found, place.take(values)
    order = values.astype(np.uint16).argsort(kind="stable")
    own = values.take(order)
    new = np.empty(len(own), bool)
    new[:1] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    place = np.empty(len(own), np.int64)
    place[order] = np.cumsum(new) - 1
    return own[new], place


def surprise(z: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """-ln p of the right turns by scores, which are written over."""
    z *= 1 - 2 * turn
    np.exp(z, out=z)
    z += 1
    return np.log(z, out=z)


def summed_rows(parts: list[np.ndarray], place: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each part, rows that go to the last places given, its sums at n places. Numbers go two and two, as complex
    ones, if they can."""
    width = parts[0].shape[1]
    pair = np.result_type(parts[0], np.complex64) if width % 2 == 0 else parts[0].dtype
    wide = width * parts[0].itemsize // pair.itemsize
    cells = np.arange(n * wide).reshape(n, wide).take(place, 0).reshape(-1)
    out = []
    for m in parts:
        out.append(np.zeros((n, width), m.dtype))
        np.add.at(out[-1].reshape(-1).view(pair), cells[-len(m) * wide :], m.reshape(-1).view(pair))
    return out


def slots(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of ids laid out in windows of ``STRIDE``: (id before each slot, with one window before the first; windows
    that begin a text; id of each slot; slots that are no filling)."""
    n = np.array([len(t) for t in texts])
    windows = -(-n // STRIDE)
    end = np.cumsum(windows) * STRIDE
    begin = end - windows * STRIDE
    y, x = np.full(end[-1], END, np.int64), np.full(end[-1] + STRIDE, END, np.int64)
    real = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    y[real] = np.concatenate(texts)
    x[STRIDE + 1 :] = y[:-1]
    x[STRIDE + begin] = END
    fresh = np.zeros(end[-1] // STRIDE, bool)
    fresh[begin // STRIDE] = True
    return x, fresh, y, real


class Model:
    """Weights: ``e`` rows of ids, first half for the head, second for the last id alone; ``q``, ``k``, ``v`` the
    head's; ``qp``, ``kp`` positions; ``u``, ``b`` the tree's decisions."""

    def __init__(self, tree: Tree, width: int = WIDTH, seed: int = 11):
        rng, ids = np.random.default_rng(seed), len(tree.length)
        self.tree, self.width = tree, width
        normal = lambda by, *shape: rng.normal(0, by, shape).astype(np.float32)
        self.w = {"e": normal(0.3, ids, 2 * width), "q": normal(0.25, width, width), "k": normal(0.25, width, width), "v": normal(0.25, width, width), "qp": np.zeros((STRIDE, width), np.float32), "kp": normal(0.1, SPAN, width), "u": np.zeros((ids - 1, width), np.float32), "b": tree.bias.copy()}
        self.mask = (np.arange(SPAN) <= np.arange(STRIDE)[:, None] + SPAN - STRIDE).astype(np.float32)

    def spans(self, m: np.ndarray) -> np.ndarray:
        """Rows as (windows, SPAN, width), overlapping, without a copy."""
        return np.lib.stride_tricks.as_strided(m, (len(m) // STRIDE - 1, SPAN, m.shape[1]), (STRIDE * m.strides[0], *m.strides))

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, fresh: np.ndarray):
        """(queries, keys, values, attention before it is divided by its sums, 1 / sums, mean values) of the slots after
        the first window, by the rows of all slots before positions are added; queries are scaled."""
        w, d, n = self.w, self.width, len(fresh)
        q = q[STRIDE:].reshape(n, STRIDE * d) + (w["qp"] * np.float32(d**-0.5)).reshape(-1)
        q = q.reshape(n, STRIDE, d)
        by, kp = k.reshape(n + 1, STRIDE * d), w["kp"].reshape(2, STRIDE * d)
        k = np.empty((n, 2, STRIDE * d), by.dtype)
        np.add(by[:-1], kp[0], out=k[:, 0])
        np.add(by[1:], kp[1], out=k[:, 1])
        k, v = k.reshape(n, SPAN, d), self.spans(v)
        p = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(np.clip(p, -30, 30, out=p), out=p)
        flat = p.reshape(n, STRIDE * SPAN)
        flat *= self.mask.reshape(-1)
        p[fresh, :, : SPAN - STRIDE] = 0
        share = np.reciprocal(p.reshape(-1, SPAN) @ np.ones(SPAN, p.dtype))
        mean = np.matmul(p, v).reshape(-1, d)
        mean *= share[:, None]
        return q, k, v, p, share, mean

    def table(self) -> list[np.ndarray]:
        """Of all ids queries, keys, values and direct terms, for scores."""
        a, d = np.ascontiguousarray(self.w["e"][:, : self.width]), self.width
        return [a @ self.w["q"] * np.float32(d**-0.5), a @ self.w["k"], a @ self.w["v"], np.ascontiguousarray(self.w["e"][:, d:])]

    def decisions(self, h: np.ndarray, keep: np.ndarray, ids: np.ndarray):
        """Of the decisions for ids, which follow h[keep], those of the top nodes, then all others: (how many an id,
        scores, 1 where the second turn is right). Besides, of the top ones their places in an array of top nodes a row
        of h, and which nodes they are; of the others rows of h, distinct nodes, the place of each in them, weights of
        nodes, states."""
        w, top = self.w, min(TOP, len(self.w["u"]))
        where, *codes = self.tree.ways(top)
        n, begin, more, more_begin = where.take(ids, 0).T.astype(np.int64)
        place = np.repeat(keep * top, n)
        code = codes[0].take(ranges(begin, n))
        place += code >> 1
        z = np.matmul(blocks(h), w["u"][:top].T).reshape(-1, top)
        z += w["b"][:top]
        z = z.reshape(-1).take(place)
        upper = n, np.clip(z, -30, 30, out=z), (code & 1).astype(z.dtype), place, code >> 1
        row = np.repeat(keep, more)
        code = codes[1].take(ranges(more_begin, more))
        node, at = distinct(code >> 1)
        u, hr = w["u"].take(node, 0).take(at, 0), h.take(row, 0)
        z = np.einsum("ij,ij->i", u, hr)
        z += w["b"].take(node).take(at)
        return upper, (more, np.clip(z, -30, 30, out=z), (code & 1).astype(z.dtype), row, node, at, u, hr)

    def score(self, texts: list[np.ndarray], table: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log p of each id, and of its first decision), for all ids of all texts."""
        table = self.table() if table is None else table
        x, fresh, y, real = slots(texts)
        ids, x = distinct(x)
        table = [t.take(ids, 0) for t in table]
        p, root, step, at = np.empty(len(real), np.float32), np.empty(len(real), np.float32), SCORE_WINDOWS * STRIDE, 0
        for i in range(0, len(y), step):
            keep = real[np.searchsorted(real, i) : np.searchsorted(real, i + step)] - i
            q, k, v, direct = (t.take(x[i : i + step + STRIDE], 0) for t in table)
            h = self.attend(q, k, v, fresh[i // STRIDE : (i + step) // STRIDE])[-1]
            h += direct[STRIDE:]
            upper, lower = self.decisions(h, keep, y[i : i + step][keep])
            own = p[at : at + len(keep)]
            (n, z), (low, more) = (x[:1] + (surprise(*x[1:3]),) for x in (upper, lower))
            first = np.cumsum(n) - n  # every way begins at the root, a top node
            np.negative(np.add.reduceat(z, first), out=own)
            np.negative(z.take(first), out=root[at : at + len(keep)])
            if len(more):
                some = np.flatnonzero(low)
                low = low.take(some)
                own[some] -= np.add.reduceat(more, np.cumsum(low) - low)
            at += len(keep)
        return p, root

    def gradients(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, keep: np.ndarray, with_loss: bool = True):
        """(loss, if it is wanted, {weights: (rows met, their gradients)}) of the ids y[keep]."""
        w, d = self.w, self.width
        ids, place = distinct(x)
        e = w["e"].take(ids, 0)
        a, direct = np.ascontiguousarray(e[:, :d]), e[:, d:]
        scale = np.float32(d**-0.5)
        project = np.concatenate([w["q"] * scale, w["k"], w["v"]], 1)
        by = a @ project
        q, k, v, p, share, mean = self.attend(*(by[:, i : i + d].take(place, 0) for i in range(0, 3 * d, d)), fresh)
        h = direct.take(place[STRIDE:], 0)
        h += mean
        upper, lower = self.decisions(h, keep, y[keep])
        loss = sum(float(surprise(z.copy(), turn).sum()) for _, z, turn, *_ in (upper, lower)) if with_loss else 0.0
        for _, z, turn, *_ in (upper, lower):  # gradients of scores
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            z -= turn
        top, (_, g, _, cells, nodes) = w["u"][:TOP], upper
        by_top = np.zeros((len(h), len(top)), h.dtype)
        by_top.reshape(-1)[cells] = g
        dh = np.matmul(blocks(by_top), top).reshape(-1, d)
        met = np.flatnonzero(np.bincount(nodes, minlength=len(top)))
        du = np.matmul(blocks(by_top).transpose(0, 2, 1), blocks(h)).sum(0)[met]
        db = (np.ones(len(h), h.dtype) @ by_top)[met]
        _, g, _, row, node, at, u, hr = lower
        if len(node):
            u *= g[:, None]
            hr *= g[:, None]
            dh += summed_rows([u], row, len(dh))[0]
            met, du = np.concatenate([met, node]), np.concatenate([du, *summed_rows([hr], at, len(node))])
            db = np.concatenate([db, np.bincount(at, g, len(node)).astype(db.dtype)])
        out = {"u": (met, du), "b": (met, db)}
        by = dh * share[:, None]
        by3 = by.reshape(-1, STRIDE, d)
        dp, dv = np.matmul(by3, v.transpose(0, 2, 1)), np.matmul(p.transpose(0, 2, 1), by3)
        dp -= np.einsum("ij,ij->i", by, mean).reshape(-1, STRIDE, 1)
        dp *= p
        dq, dk = np.matmul(dp, k).reshape(-1, d), np.matmul(dp.transpose(0, 2, 1), q)
        both = []
        for halves in (dk.reshape(-1, 2, STRIDE * d), dv.reshape(-1, 2, STRIDE * d)):
            m = np.empty((len(fresh) + 1, STRIDE * d), h.dtype)
            m[0], m[1:] = 0, halves[:, 1]
            m[:-1] += halves[:, 0]
            both.append(m.reshape(-1, d))
        *dqkv, direct = summed_rows([dq, *both, dh], place, len(ids))
        dqkv = np.concatenate(dqkv, 1)
        out["e"] = ids, np.concatenate([dqkv @ project.T, direct], 1)
        dw = a.T @ dqkv
        whole = {"q": dw[:, :d] * scale, "k": dw[:, d : 2 * d], "v": dw[:, 2 * d :], "qp": dq.reshape(-1, STRIDE * d).sum(0).reshape(-1, d) * scale, "kp": dk.reshape(-1, SPAN * d).sum(0).reshape(-1, d)}
        return loss, out | {name: (np.arange(len(m)), m) for name, m in whole.items()}


class Trainer:
    """Adagrad with one rate a row; counts how many batches met each row."""

    WHOLE = "q", "k", "v", "qp", "kp"  # met in every batch, so one array

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.met = {k: np.zeros(len(m), np.float32) for k, m in model.w.items()}
        self.met["b"] = self.met["u"]
        self.whole = np.concatenate([model.w[k] for k in self.WHOLE])
        for k, m in zip(self.WHOLE, np.split(self.whole, np.cumsum([len(model.w[k]) for k in self.WHOLE])[:-1]), strict=True):
            model.w[k] = m
        self.squares = {k: np.full(len(m), 1e-2, np.float32) for k, m in [*model.w.items(), ("whole", self.whole)]}

    def step(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, keep: np.ndarray) -> None:
        grads = self.model.gradients(x, fresh, y, keep, with_loss=False)[1]
        for name in ("e", "u", "b"):
            at, g = grads[name]
            square = self.squares[name].take(at)
            square += np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim == 2 else g * g
            self.squares[name][at] = square
            rate = np.float32(self.rate) / np.sqrt(square)
            w = self.model.w[name]
            rows = w.take(at, 0)
            g *= rate[:, None] if g.ndim == 2 else rate
            rows -= g
            w[at] = rows
        self.met["e"][grads["e"][0]] += 1
        self.met["u"][grads["u"][0]] += 1
        g = np.concatenate([grads[k][1] for k in self.WHOLE])
        square = self.squares["whole"]
        square += np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.whole -= g * (np.float32(0.3 * self.rate) / np.sqrt(square))[:, None]
        for k in self.WHOLE:
            self.met[k] += 1

    def batches(self, texts: list[np.ndarray]) -> None:
        """Steps over all windows of all texts."""
        x, fresh, y, real = slots(texts)
        step = TRAIN_WINDOWS * STRIDE
        for i in range(0, len(y), step):
            keep = real[np.searchsorted(real, i) : np.searchsorted(real, i + step)] - i
            self.step(x[i : i + step + STRIDE], fresh[i // STRIDE : (i + step) // STRIDE], y[i : i + step], keep)


class Lookup:
    """Values by 64-bit hash. Hashes are even over their range, so their upper bits lead to a bucket of the
    sorted list with one entry on average."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        by = np.argsort(keys)
        self.keys, self.values, self.shift = keys[by], values[by], np.uint64(64 - bits)
        edges = np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=np.float64).astype(np.uint64)[:-1] << self.shift)
        self.first = np.append(edges, len(keys)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, place) of each hash."""
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        found, place = np.zeros(len(h), bool), at.copy()
        rest = np.flatnonzero(at < end)
        while len(rest):
            hit = self.keys[place[rest]] == h[rest]
            found[rest[hit]] = True
            rest = rest[~hit]
            place[rest] += 1
            rest = rest[place[rest] < end[rest]]
        return found, place


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _prepared(tokenizer: str):
    """kind 0: (doc_id, text, subword ids); of training texts kind 1: (word, count), kind 2: (subword, count)."""
    names = ["kind", "doc_id", "text", "ids", "item", "n"]

    def stats(kind: int, item: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = len(item)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(item.astype(np.int64)), pa.array(n.astype(np.int64))], names=names)

    def summed(v: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(np.concatenate(v), return_inverse=True)
        return u, np.bincount(at, np.concatenate(c)).astype(np.int64)

    def run(batches):
        gc.disable()  # no cycles are made here, and a full collection walks the whole cache
        own, pieces = subwords(tokenizer), np.zeros(VOCABULARY, np.int64)
        words, counts, held = [], [], 0
        for b in batches:
            for rows in chunked(zip(b.column("doc_id").to_pylist(), (x or b"" for x in b.column("text").to_pylist()), strict=True), CHUNK_BYTES):
                texts = [t for _, t in rows]
                ids, distinct, which, n = own.encode(texts)
                k = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array([d for d, _ in rows], pa.int64()), pa.array(texts, pa.binary()), pa.array(ids, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
                train = np.array([not is_held_out(d) for d, _ in rows])
                if not train.any():
                    continue
                pieces += np.bincount(np.frombuffer(b"".join(compress(ids, train)), np.uint16), minlength=VOCABULARY)
                c = np.bincount(which[np.repeat(train, n)], minlength=len(distinct))
                words.append(np.append(distinct[c > 0], END_WORD))
                counts.append(np.append(c[c > 0], train.sum()))
                held += len(words[-1])
                if held > HELD_WORDS:
                    v, c = summed(words, counts)
                    if len(v) > HELD_WORDS // 2:
                        yield stats(1, v.view(np.int64), c)
                        words, counts, held = [], [], 0
                    else:
                        words, counts, held = [v], [c], len(v)
        if words:
            v, c = summed(words, counts)
            yield stats(1, v.view(np.int64), c)
        if pieces.any():
            at = np.flatnonzero(pieces)
            yield stats(2, at, pieces[at])
        gc.enable()

    return run


MOVE = "name string, block int, met binary, moved binary"


def _trained(model, rate: float):
    """(name, block, met, moved) of a task: how its training texts move each block of rows, weighted by how often
    each row was met."""

    def run(batches):
        trainer, start = None, model.value
        for b in batches:
            for rows in chunked(((x,) for x in b.column("ids").to_pylist()), CHUNK_BYTES):
                if trainer is None:
                    own = Model.__new__(Model)
                    own.__dict__ |= start.__dict__ | {"w": {k: v.copy() for k, v in start.w.items()}}
                    trainer = Trainer(own, rate)
                trainer.batches([np.frombuffer(r[0], np.uint16) for r in rows])
        if trainer is None:
            return
        for name, now in trainer.model.w.items():
            for i in range(0, len(now), BLOCK_ROWS):
                met = trainer.met[name][i : i + BLOCK_ROWS]
                if met.any():
                    moved = (now[i : i + BLOCK_ROWS] - start.w[name][i : i + BLOCK_ROWS]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // BLOCK_ROWS], pa.int32()), pa.array([met.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], names=["name", "block", "met", "moved"])

    return run


def _summed(batches):
    """Of a partition's messages one a block: sums of ``met`` and of moves weighted by it."""
    total: dict[tuple[str, int], list[np.ndarray]] = {}
    for b in batches:
        for name, block, met, moved in zip(*(b.column(c).to_pylist() for c in ("name", "block", "met", "moved")), strict=True):
            n = np.frombuffer(met, np.float32).astype(np.float64)
            move = np.frombuffer(moved, np.float16).astype(np.float64).reshape(len(n), -1) * n[:, None]
            held = total.setdefault((name, block), [np.zeros_like(n), np.zeros_like(move)])
            held[0] += n
            held[1] += move
    for (name, block), (n, move) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([(move / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["name", "block", "met", "moved"])


def train(texts: DataFrame, model: Model) -> None:
    """Moves the model's weights by rounds over (ids) of all training texts, each of them in the round that its checksum
    gives. What the driver gets is one row a block."""
    for r in range(ROUNDS):
        sent = texts.sparkSession.sparkContext.broadcast(model)
        moves = texts.where(F.crc32("ids") % ROUNDS == r).mapInArrow(_trained(sent, RATE / (1 + r)), MOVE).repartition("name", "block").mapInArrow(_summed, MOVE).toArrow()
        sent.unpersist()
        for name, block, moved in zip(*(moves.column(c).to_pylist() for c in ("name", "block", "moved")), strict=True):
            rows = model.w[name][block * BLOCK_ROWS : (block + 1) * BLOCK_ROWS]
            rows += np.frombuffer(moved, np.float32).reshape(rows.shape)


class Words:
    """What the shares of words besides the attention model's need: training tokens and how many are distinct."""

    def __init__(self, tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        left = DISCOUNT * distinct / tokens if tokens else 1.0
        self.spelled = np.log((1 - MEMORY) + MEMORY * left)  # weight of the attention model
        self.counted = np.log(MEMORY / tokens) if tokens else -np.inf  # weight of a count

    def parts(self, log_p: np.ndarray, earlier: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log of all but the counted share, log weight of a count) by the attention model's log p of words, how often
        each stood earlier in its text, and how many words did."""
        copy = COPY * place / (place + COPY_AFTER)
        kept = np.log(1 - copy)
        spelled = kept + self.spelled + log_p
        copied = copy * earlier / np.maximum(place, 1)
        with np.errstate(divide="ignore"):
            rest = np.where((copied > 0) | (spelled > -600), np.log(copied + np.exp(spelled)), spelled)  # no sum where it can't be told from 0
        return rest, kept + self.counted

    def log10(self, rest: np.ndarray, weight: np.ndarray, n: np.ndarray) -> np.ndarray:
        more = np.maximum(n - DISCOUNT, 0) * np.exp(weight)
        with np.errstate(divide="ignore"):
            return np.where((more > 0) | (rest > -600), np.log(more + np.exp(rest)), rest) / np.log(10)


def earlier(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many earlier words of the same text are equal."""
    key = mix(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64((1 << max(1, len(key).bit_length())) - 1)
    order = (np.sort(key & ~low | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)  # places in the keys' low bits
    own = key[order]
    if ((own[1:] != own[:-1]) & (own[1:] & ~low == own[:-1] & ~low)).any():  # keys that differ in low bits alone
        order = np.argsort(key, kind="stable")
        own = key[order]
    begin = runs(own)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    return out


def word_scores(model: Model, table: list[np.ndarray], starts: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """log p by the attention model of each word and end of all texts: its ids, and that then a word begins."""
    p, root = model.score(texts, table)
    ids = np.concatenate(texts)
    begin = np.flatnonzero(starts[ids])
    own = np.add.reduceat(p.astype(np.float64), begin) - root[begin]
    after = np.append(root[begin[1:]], np.float32(0))
    after[ids[begin] == END] = 0
    return own + after


def _scored(model, common, words: Words, scale: float, tokenizer: str):
    """kind 0: (doc_id, key, words, known, base, score) by the broadcast words alone; kind 1: (key, word, rest,
    weight) for each of the others; kind 2: (key) once for each time a key's other words are sent."""
    names = ["kind", "doc_id", "key", "word", "n", "known", "base", "score"]

    def run(batches):
        lm, known_words, starts = model.value, common.value, subwords(tokenizer).starts
        table = lm.table()
        (has_end,), (end,) = known_words.find(np.array([END_WORD]))
        end_count = known_words.values[end] if has_end else 0.0
        for b in batches:
            for rows in chunked(zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("text").to_pylist(), strict=True), CHUNK_BYTES):
                hashes, n = word_hashes([t for *_, t in rows])
                k = len(rows)
                of = np.repeat(np.arange(k), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                key = mix(np.bincount(of, minlength=k).astype(np.uint64))
                np.add.at(key, of, mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                hit, at = known_words.find(hashes)
                count = np.where(hit, known_words.values[np.where(hit, at, 0)], 0.0) if len(known_words.values) else np.zeros(len(hit))
                known = np.bincount(of[hit], minlength=k) + int(has_end)
                base = np.bincount(of[hit], np.log10(count[hit] + 1) - scale, minlength=k) + np.log10(end_count + 1) - scale
                log_p = word_scores(lm, table, starts, [np.frombuffer(i, np.uint16) for _, i, _ in rows])
                is_end = np.zeros(len(log_p), bool)
                is_end[np.cumsum(n + 1) - 1] = True
                rest, weight = words.parts(log_p[~is_end], earlier(of, hashes), place)
                score = np.bincount(of[hit], words.log10(rest[hit], weight[hit], count[hit]), minlength=k)
                score += words.log10(*words.parts(log_p[is_end], np.zeros(k), n), np.full(k, end_count))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(k, np.int32)), pa.array([r[0] for r in rows], pa.int64()), pa.array(key.view(np.int64)), pa.nulls(k, pa.int64()), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], names=names
                )
                first = np.zeros(k, bool)
                first[np.unique(key, return_index=True)[1]] = True
                rare = ~hit & first[of]
                pair = key[of[rare]], hashes[rare]
                sent = np.unique(pair[0])
                m, r = len(pair[0]) + len(sent), len(pair[0])
                none = np.zeros(len(sent))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([1, 2], [r, len(sent)]).astype(np.int32)), pa.nulls(m, pa.int64()), pa.array(np.concatenate([pair[0], sent]).view(np.int64)), pa.array(np.concatenate([pair[1], sent]).view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.concatenate([weight[rare], none])), pa.array(np.concatenate([rest[rare], none]))], names=names
                )

    return run


def score_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = materialize(texts.mapInArrow(_prepared(tokenizer), "kind int, doc_id long, text binary, ids binary, item long, n long"), "subwords", compression="zstd")
    counts = materialize(rows.where("kind = 1").groupBy("item").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scale = float(np.log10(total + distinct + 1))
    top = commonest(counts, "n", COMMON).toArrow()  # COMMON rows at most
    common = spark.sparkContext.broadcast(Lookup(top.column("item").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)))

    pieces = np.zeros(VOCABULARY, np.int64)
    for r in rows.where("kind = 2").groupBy("item").agg(F.sum("n").alias("n")).collect():  # a row a subword
        pieces[r["item"]] = r["n"]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    lm = Model(Tree(pieces, subwords(tokenizer).starts))
    train(rows.where(F.col("kind") == 0).where(~held).select("ids"), lm)
    model = spark.sparkContext.broadcast(lm)

    schema = "kind int, doc_id long, key long, word long, n long, known long, base double, score double"
    scored = materialize(rows.where("kind = 0").select("doc_id", "ids", "text").mapInArrow(_scored(model, common, Words(int(total), int(distinct)), scale, tokenizer), schema), "scored")
    common.unpersist()
    model.unpersist()
    n, rest = F.coalesce("n", F.lit(0)), F.col("rest")
    more = F.when(n > 0, F.col("weight") + F.log(n - DISCOUNT))
    mixed = F.when(more.isNull() | (more == float("-inf")), rest).otherwise(F.greatest(rest, more) + F.log1p(F.exp(F.least(rest, more) - F.greatest(rest, more))))
    rare = scored.where("kind = 1").select("key", "word", F.col("base").alias("weight"), F.col("score").alias("rest")).join(counts, F.col("word") == F.col("item"), "left")
    rare = rare.select("key", F.lit(0).alias("sent"), (n > 0).cast("long").alias("known"), (F.log10(n + 1.0) - scale).alias("base"), (mixed / float(np.log(10))).alias("score"))
    sent = scored.where("kind = 2").select("key", F.lit(1).alias("sent"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"))
    other = rare.unionByName(sent).groupBy("key").agg(F.sum("sent").alias("sent"), F.sum("known").alias("more"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    return (
        scored.where("kind = 0").select("doc_id", "key", "n", "known", "base", "score").join(other, "key", "left").select(
            "doc_id", held.alias("held_out"), F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce((F.col("more") / F.col("sent")).cast("long"), F.lit(0))).alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce(F.col("more_base") / F.col("sent"), F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce(F.col("more_score") / F.col("sent"), F.lit(0.0))).alias("score"),
        )
    )


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
