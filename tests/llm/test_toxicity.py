"""Toxicity classifier: held-out accuracy on planted words and on the tables, window by window properties, dirty input."""

import random
import zlib

import numpy as np
import pytest

import codestrata.llm.toxicity as m
from codestrata.llm.toxicity import Model, calibrate, fit, labelled, op11_compression_toxicity, score, windows

RUDE = ["blargmox", "fnurtwik", "skoodrapt", "ghwizzled", "prattlonk"]
PARTS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "re", "vo") for b in ("ra", "li", "no", "ve", "du", "st", "n")]


def prose(rng, n, rude=0.0):
    return " ".join(rng.choice(RUDE) if rng.random() < rude else "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(rng, n):
    """(id, text, truly toxic, label); one label in fifty of the clean ones is wrong."""
    out = []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = rng.randint(30, 250)
        text = prose(rng, words, 0.04 if toxic else 0)
        if toxic and not any(w in text for w in RUDE):
            text += " " + " ".join(rng.sample(RUDE, 3))
        out.append((i, text, int(toxic), int(toxic or rng.random() < 0.02)))
    return out


@pytest.fixture(scope="module")
def made():
    return corpus(random.Random(3), 1600)


@pytest.fixture(scope="module")
def model(made):
    learnt = made[:1100]
    return Model([t.encode() for _, t, _, _ in learnt], [y for *_, y in learnt], 0.2)


def test_held_out_texts(made, model):
    late = made[1100:]
    s = model.score([t.encode() for _, t, _, _ in late])
    truth = np.array([k for _, _, k, _ in late])
    assert (s[truth == 1] >= m.THRESHOLD).mean() > 0.9
    assert (s[truth == 0] >= m.THRESHOLD).mean() < 0.02
    assert ((0 <= s) & (s <= 1)).all()


def test_whole_long_texts_count(model):
    rng = random.Random(9)
    clean = prose(rng, 40000)
    late = clean + " " + prose(rng, 4000, 0.5)
    low, high = model.score([clean.encode(), late.encode()])
    assert low < 0.3 and high > 0.9
    assert b"".join(x for _, p in m._pieces([late.encode(), b""]) for x in p) == late.encode()


def test_windows_cover_every_word():
    text = "One two  THREE\tfour\x0bfive " + "x" * 700 + " é"
    got = windows(text.encode())
    assert b"".join(got).replace(b" ", b"") == "".join(text.lower().split()).encode()
    assert max(map(len, got)) <= m.LONGEST and windows(b" \n") == []


def test_sizes_equal_single_frames(model):
    import zstandard

    parts = windows(prose(random.Random(1), 60, 0.1).encode()) + [b"", b"a"]
    content = zstandard.ZstdCompressionDict(model.toxic.raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    one = zstandard.ZstdCompressor(dict_data=content, compression_params=m._SETTINGS)
    assert model.toxic.sizes(parts).tolist() == [len(one.compress(p + m.MARK)) for p in parts]


def test_equal_words_have_no_distance(model):
    of, saved = model.distances([b"kara lino mive " * 50])
    assert len(set(saved.tolist())) == 1 and abs(saved[0]) <= 1
    of, saved = model.distances([" ".join(RUDE * 3).encode()])
    assert (saved >= model.least).all()


def test_calibration_withstands_wrong_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.1
    total = rng.integers(20, 200, 4000)
    marked = rng.binomial(total, np.where(truth, 0.05, 0.001))
    y = (truth | (rng.random(4000) < 0.05)).astype(float)
    w, wrong, _ = calibrate(m._terms(marked, total), y, np.ones(4000))
    s = labelled(m._sigmoid(m._terms(marked, total) @ w), wrong)
    assert abs(wrong[0] - 0.05) < 0.03
    assert (s[truth] >= 0.7).mean() > 0.85 and (s[~truth] >= 0.7).mean() < 0.02


def test_table_held_out(spark):
    path = "/root/testdata/sf0.1"
    got = op11_compression_toxicity(spark, path)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [(r["predicted"], labels[i]) for i, r in rows.items() if r["held_out"] and i in labels]
    # 42 % of the positive labels of this table mark texts that nothing tells from clean ones.
    assert np.mean([p == y for p, y in held]) > 0.92
    assert np.mean([p for p, y in held if not y]) < 0.01
    assert np.mean([p for p, y in held if y]) > 0.45
    assert got.count() == spark.read.parquet(f"{path}/documents.parquet").count()


def test_dirty_input(spark, dirty, nothing, made):
    labels = spark.createDataFrame([(i, 1, k) for i, _, _, k in made[:700]] + [(None, 1, 1), (5, 1, None), (701, 1, 1), (701, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made[:702]], "doc_id long, text string")
    learnt = fit(docs, labels)
    assert learnt.weights is not None
    clash = dirty.withColumnRenamed("class", "toxicity").withColumnRenamed("kind", "bytes")
    got = score(clash, learnt)
    assert got.columns == [*clash.columns, "n_windows", "n_marked"]
    got = score(dirty, learnt, keep=["doc_id", "kind"])
    rows = got.collect()
    assert len(rows) == dirty.count() and all(0 <= r["toxicity"] <= 1 for r in rows)
    empty = {r["toxicity"] for r in rows if r["doc_id"] in (300, 301, 302)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert score(nothing, learnt).count() == 0
    nobody = fit(docs, labels.where("false"))
    assert nobody.weights is None and {r["toxicity"] for r in score(dirty, nobody).collect()} == {0.5}
    one_kind = fit(docs, labels.where("toxic = 0"))
    assert one_kind.weights is None and next(iter(one_kind.score([b"x"]))) < 0.01


def test_nobody_learns_from_held_out_labels(spark, made):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made[:300]], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in held], "doc_id long, quality int, toxic int")
    assert fit(docs, labels).constant == 0.5
