"""Periodic runs against a brute-force version that follows the definition word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codestrata.llm.periodic_runs import Extensions, find_runs, kept_words, op13_harmonic_runs, periodic_runs, planted


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute_runs(w):
    found = set()
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p) and smallest_period(w[i : j + p]) == p:
                found.add((i, j + p - i, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    out = set()
    for s, length, q in runs:
        out |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    text = b" ".join(x for i, x in enumerate(w) if i not in out)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_extensions_equal_direct_comparison():
    rng = np.random.default_rng(4)
    for n, letters in ((1, 1), (2, 1), (60, 1), (200, 2), (300, 5)):
        s = rng.integers(0, letters, n)
        a, b = rng.integers(0, n + 1, 400), rng.integers(0, n + 1, 400)
        a, b = a[a != b], b[a != b]
        direct = [next((k for k in range(n) if max(x, y) + k >= n or s[x + k] != s[y + k]), 0) for x, y in zip(a, b, strict=True)]
        assert Extensions(s)(a, b).tolist() == direct


def test_runs_equal_brute_force():
    rng = random.Random(8)
    texts = [[], [0], [3] * 6, [3] * 5, [0, 1] * 4, [0, 1, 2] * 4 + [0], ([0] * 8 + [1]) * 5]
    for _ in range(300):
        w = []
        while len(w) < rng.randint(1, 90):
            unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 5))]
            w += unit * rng.choice([1, 1, 2, 4, 5, 9])
        texts.append(w)
    got = find_runs([np.array(t, np.int64) for t in texts])
    for t, r in zip(texts, got, strict=True):
        assert [tuple(x) for x in r.tolist()] == brute_runs(t)
    assert any(len(r) > 3 for r in got)
    assert kept_words(12, find_runs([np.array([0, 1, 2] * 4)])[0]).tolist() == [True] * 3 + [False] * 9


def test_blocks_and_batches_change_nothing(monkeypatch):
    import codestrata.llm.periodic_runs as m

    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(50)]
    whole = m._answers(texts)
    monkeypatch.setattr(m, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(m, "BATCH_WORDS", 40)
    parts = m._answers(texts)
    assert whole[0] == parts[0] and whole[2] == parts[2] and [r.tolist() for r in whole[1]] == [r.tolist() for r in parts[1]]


def test_table_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op13_harmonic_runs(spark, path).collect()}
    want = {r["doc_id"]: brute_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    assert got == want
    assert sum(r[1] for r in got.values()) > 20


def test_dirty_input(spark, dirty, nothing, monkeypatch):
    import codestrata.llm.periodic_runs as m

    rows = dirty.withColumnRenamed("class", "runs")
    found = periodic_runs(rows)
    assert found.columns == [c for c in rows.columns if c != "runs"] + ["n_words", "runs", "collapsed"]
    assert found.count() == dirty.count()
    small = dirty.where("doc_id is null or n_chars is null or n_chars < 5000")
    monkeypatch.setattr(m, "table", lambda spark, sf_dir, name: small)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op13_harmonic_runs(spark, "").collect()), key=str)
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in small.collect()), key=str)
    assert {r["doc_id"]: r["n_words"] for r in found.collect()}[300] == 0
    assert periodic_runs(nothing).count() == 0


def test_long_text_of_one_word(spark):
    one = spark.createDataFrame([(1, "ab " * 120000), (5, "x y\x0b" * 30000 + "z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in periodic_runs(one).collect()}
    assert [tuple(r) for r in got[1][0]] == [(0, 120000, 1)] and got[1][1] == "ab"
    assert [tuple(r) for r in got[5][0]] == [(0, 60000, 2)] and got[5][1] == "x y z"


@pytest.mark.parametrize("text", [None, "", " \t\n", "\x0b"])
def test_planting_leaves_wordless_texts(spark, text):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    assert {r[0] for r in df.select(planted()).collect()} == {text}
