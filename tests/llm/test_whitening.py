"""Whitening against numpy on the distinct integer vectors."""

import numpy as np
import pytest

import codestrata.llm.whitening as m
from codestrata.llm.whitening import Centre, fit, integers, op12_two_pass_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """{vec_id: (n, deviation)}, and (distinct vectors, eigenvalues, explained)."""
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows}
    once = sorted({tuple(v) for v in x.values()})
    n, total = len(once), [sum(c) for c in zip(*once, strict=True)]
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True)) for i, v in x.items()}
    a = np.array(once, float)
    cov = np.cov((a - a.mean(0)).T, bias=True)
    e = np.linalg.eigvalsh(cov)[::-1]
    return dev, n, a, cov, e


def check(got, rows, components=16):
    dev, n, a, cov, e = brute(rows)
    k = min(components, len(cov))
    of = {}
    for r in got:
        of.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(of) == set(dev) and all(sorted(c) == list(range(1, k + 1)) for c in of.values())
    assert all(r["n"] == n and r["deviation"] == dev[r["vec_id"]] for r in got)
    assert all(abs(r["explained"] / (e[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9 for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got)
    x = {i: np.array([np.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows}
    values, vectors = np.linalg.eigh(cov)
    for c in range(k):
        want = np.array([(x[i] - a.mean(0)) @ vectors[:, -1 - c] / np.sqrt(values[-1 - c]) for i in of])
        have = np.array([of[i][c + 1]["whitened"] for i in of])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-6


def test_table_equals_numpy(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect() if r["embedding"]]
    check(op12_two_pass_whitening(spark, path).collect(), rows)


def test_dirty_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=4) * [3, 2, 1, 0.5]]) for i in range(40)]
    good += [(100 + i, good[0][1]) for i in range(30)]  # copies count once in the fit
    nan, inf = float("nan"), float("inf")
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [nan, 1.0, 1.0, 1.0]), (204, [inf, 1.0, 1.0, 1.0]), (205, [-inf, 1.0, 1.0, 1.0]), (206, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], SCHEMA).repartition(5)
    monkeypatch.setattr(m, "BLOCK_BYTES", 64)
    monkeypatch.setattr(m, "table", lambda *_: df.withColumnRenamed("label", "x"))
    check(op12_two_pass_whitening(spark, "").collect(), good)
    twice = df.where("vec_id < 2").union(spark.createDataFrame([(None, good[5][1], 0), (1, good[1][1], 0)], SCHEMA))
    x = integers(twice)
    assert whiten(x, fit(x)).where("component = 1").count() == 4


def test_without_spread(spark):
    x = integers(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA))
    got = whiten(x, fit(x)).collect()
    assert len(got) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    x = integers(spark.createDataFrame([(1, [1.0, 5.0], 0), (2, [2.0, 5.0], 0)], SCHEMA))
    got = {(r["vec_id"], r["component"]): r for r in whiten(x, fit(x)).collect()}
    assert abs(abs(got[1, 1]["whitened"]) - 1) < 1e-12 and got[1, 2]["whitened"] is None and got[2, 1]["explained"] == 1 and got[1, 1]["identity_error"] < 1e-12
    empty = integers(spark.createDataFrame([], SCHEMA))
    assert fit(empty) is None and whiten(empty, None).count() == 0


def test_extreme_entries_are_exact(spark):
    far = float(np.float32(3e38))
    x = integers(spark.createDataFrame([(1, [far, 0.0], 0), (2, [-far, 1.0], 0), (3, [1e6, 1.0], 0)], SCHEMA))
    got = {r["vec_id"]: r["x"] for r in x.collect()}
    assert got[1] == [2**61 + 1_000_000, 1_000_000] and got[2][0] == -(2**61) + 1_000_000 and got[3] == [65_000_000, 1_000_064]
    n, total = m.sums(x.select("x"))
    assert (n, total) == (3, [65_000_000 + 2_000_000, 3_000_128])
    deviation = {r["vec_id"]: r["deviation"] for r in whiten(x, fit(x)).collect()}
    assert deviation == {1: None, 2: None, 3: (3 * 65_000_000 - total[0]) ** 2 + (3 * 1_000_064 - total[1]) ** 2}


def test_deviation_beyond_64_bits_is_null():
    c = Centre(2, [2 * 10**6 + 10, 2 * 10**6])
    assert c.deviation(np.array([[10**6 + 5, 10**6], [10**6, 10**6]])) == [0, 100]
    assert c.deviation(np.array([[10**6 + 5, 10**6], [2**60, 10**6], [10**6 + 2**30, 10**6]])) == [0, None, (2 * (2**30 - 5)) ** 2]


def test_mean_has_no_rounding(spark):
    rows = [(i, [float(c) for c in np.random.default_rng(i).normal(size=3)], 0) for i in range(3000)]
    x = integers(spark.createDataFrame(rows, SCHEMA).repartition(7)).select("x")
    n, total = m.sums(x)
    assert n == 3000 and total == [sum(r["x"][k] for r in x.collect()) for k in range(3)]


def test_width_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(m, "WIDEST", 2)
    x = integers(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], SCHEMA))
    with pytest.raises(ValueError):
        fit(x)
