"""Words and word shingles of whole batches of texts, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased, both on UTF-8 bytes. A word's hash is a polynomial
over its bytes modulo 2^64, mixed; all words of a batch come from one prefix sum, so the cost is a few array
operations a byte and no Python a word. A shingle's hash combines its words' hashes. Equality of words and
shingles is equality of these 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_bytes = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_places = np.random.default_rng(20240301).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_bytes[65:91] = _bytes[97:123]
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_MULTIPLIER, _INVERSE):
            p = np.full(max(n, CHUNK_BYTES + 65536), base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text)."""
    return hashed_words(texts)[:2]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, words of each text, where words begin and end in the texts joined by spaces)."""
    buf = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    space = _space[buf]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    begin, end = edge[::2], edge[1::2]
    up, down = powers_to(len(buf) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_bytes[buf] * up[: len(buf)])])
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, limits), prepend=0)
    return hashes, counts, begin, end


def _ranked(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(h) >> np.uint64(6) | (np.uint64(63) - np.minimum(length // 2, 63).astype(np.uint64)) << np.uint64(58)


def groups(h: np.ndarray, bits: int) -> np.ndarray:
    """Hash groups 0 .. 2**bits - 1 of shingles; with one bit less, neighbours fall together."""
    return ((h << np.uint64(6)) >> np.uint64(64 - bits)).astype(np.int64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; fewer words than a shingle make one of all of them; none: empty.

    The upper 6 bits of a shingle are smaller the longer its words are together, so sorting by hash puts long
    shingles, which chance repeats least, first; the other 58 bits are the hash.
    """
    hashes, counts, begin, end = hashed_words(texts)
    n, lengths = len(hashes), end - begin
    runs = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        runs += hashes[k : k + len(runs)] * _places[k]
    total = np.concatenate([[0], np.cumsum(lengths)])
    runs = _ranked(runs, total[SHINGLE:] - total[:-SHINGLE] if n >= SHINGLE else total[:0])
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(runs[at : at + c - SHINGLE + 1]))
        elif c:
            out.append(_ranked((hashes[at : at + c] * _places[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c), lengths[at : at + c].sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def chunked(rows: Iterable[tuple], most: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Rows whose last item is bytes, in lists of about ``most`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
