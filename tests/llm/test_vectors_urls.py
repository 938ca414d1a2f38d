import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import ann, exact_topk, url_filter, vectors

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), "x", 1.0) for i in range(300)]
    rows += [(400 + i, rows[7][1], "x", 1.0) for i in range(40)]  # ties
    rows += [rows[3], rows[50]]  # repeated rows
    rows += [(500, None, "x", 1.0), (550, [], "x", 1.0), (600, [0.0] * 6, "x", 1.0), (650, [1.0, NAN, 0.0, 0.0, 0.0, 0.0], "x", 1.0), (700, [1.0, INF, 0.0, 0.0, 0.0, 0.0], "x", 1.0), (750, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1.0), (800, [1.0, 2.0], "x", 1.0), (None, [1.0] * 6, "x", 1.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, g string, score double").repartition(4)


def brute(table, k, nonzero, score):
    rows = {}
    for r in table.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero):
            rows[r["vec_id"]] = np.array(v, np.float64)
    out = {}
    for q in rows:
        if q % 50 == 0:
            out[q] = sorted(((-score(rows[q], rows[c]), c) for c in rows if c != q))[:k]
    return out


def test_exact_topk(table):
    rows = exact_topk.quantised(vectors.valid(table))
    got = exact_topk.voronoi_topk(rows, rows.where("vec_id % 50 = 0"), k=5, n_pivots=8, n_witnesses=32, block_rows=40, query_block_rows=3).collect()
    want = brute(table, 5, False, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert found == want
    assert 600 in want


def test_products_of_large_numbers():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**12, 5.0], [2.0**50, 0.0]])
    assert exact_topk.products(q, x).tolist() == [[2**52 + 15, 2**63 - 1]]


def test_forest(spark, table):
    rows = vectors.valid(table, nonzero=True)
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    want = brute(table, 5, True, cosine)
    for options in ({"cover": 1.0}, {"cover": 1.0, "block_bytes": 1 << 12}):  # all leaves, in one block and in many
        got = ann.forest_search(rows, rows.where("vec_id % 50 = 0"), **options).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r["query_id"], []).append(r)
        assert set(found) == set(want) and 600 not in found
        for q, best in want.items():
            assert [round(r["score"], 9) for r in found[q]] == [round(-s, 9) for s, _ in best]


def test_forest_recall(spark):
    """At the production setting, on vectors without clusters (the hardest) and with some."""
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(3000, 32))
    centres = rng.normal(size=(60, 32)) * 3
    for x in (plain, centres[rng.integers(0, 60, 3000)] + plain):
        df = vectors.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), nonzero=True)
        got = ann.forest_search(df, df.where("vec_id % 50 = 0")).collect()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        hits = 0
        for q in range(0, 3000, 50):
            s = u @ u[q]
            s[q] = -9
            hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
        assert hits / 300 >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<float>")
    rows = vectors.valid(df, nonzero=True)
    got = ann.forest_search(rows, rows.where("vec_id % 50 = 0")).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)}
    none = vectors.valid(df.where("vec_id > 99"))
    assert ann.forest_search(none, none).count() == 0 and exact_topk.voronoi_topk(none, none).count() == 0
    one = vectors.valid(df.where("vec_id = 0"))
    assert ann.forest_search(one, one).count() == 0 and exact_topk.voronoi_topk(exact_topk.quantised(one), exact_topk.quantised(one)).count() == 0


def test_url_keys(spark):
    urls = ["HTTP://u@WWW.Ex.com:80/a/b?q#f", "https://ex.com", "nope", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.keys(F.col("u"))).collect()]
    first = {tuple(k) for k in got[0]}
    assert first == {("host", "www.ex.com"), ("domain", "www.ex.com"), ("domain", "ex.com"), ("domain", "com"), ("prefix", "www.ex.com/"), ("prefix", "www.ex.com/a/"), ("prefix", "www.ex.com/a/b")}
    assert got[2:] == [None, None, None]


def test_temporal_join(spark):
    d = lambda s: datetime.date.fromisoformat(f"2024-{s}")
    log = [
        ("host", "a.com", "add", d("01-10")), ("host", "a.com", "add", d("01-12")), ("host", "a.com", "remove", d("02-01")), ("host", "a.com", "add", d("03-01")),
        ("domain", "b.org", "add", d("01-01")), ("domain", "b.org", "remove", d("01-01")), ("prefix", "c.net/x/", "add", d("01-01")), ("host", None, "add", d("01-01")), ("host", "z", "frob", d("01-01")),
    ]
    listed = url_filter.intervals(spark.createDataFrame(log, "kind string, entry string, action string, at date"))
    assert {tuple(r) for r in listed.collect()} == {("host", "a.com", d("01-10"), d("02-01")), ("host", "a.com", d("03-01"), None), ("prefix", "c.net/x/", d("01-01"), None)}
    cap = [(1, "http://a.com/", d("01-09")), (2, "http://a.com/", d("01-10")), (3, "http://a.com/q", d("02-01")), (4, "http://a.com", d("03-01")), (5, "http://s.b.org/", d("01-05")), (6, "http://c.net/x/y", d("01-05")), (7, "http://c.net/xy", d("01-05")), (8, None, d("01-05")), (9, "http://a.com/", None), (2, "http://a.com/", d("01-10"))]
    got = {r["page_id"]: r for r in url_filter.evaluate(spark.createDataFrame(cap, "page_id long, url string, day date"), listed).collect()}
    assert {k for k, r in got.items() if r["blocked"]} == {2, 4, 6} and len(got) == 9
    assert got[2]["captures"] == 2 and got[6]["first_entry"] == "prefix:c.net/x/" and got[8]["first_entry"] is None
    none = listed.where("false")
    assert not any(r["blocked"] for r in url_filter.evaluate(spark.createDataFrame(cap, "page_id long, url string, day date"), none).collect())
