"""Containment by one sorted pass against the definition, and in linear time."""

import random
import time

import pytest

from codestrata.operators import intervals as I
from codestrata.operators import syntax as Y
from codestrata.operators.sweep import Stairs, containers

RANGE = "path string, id string, lo int, hi int"


def smallest(ranges, outer):
    out = {}
    for p, i, lo, hi in ranges:
        if p is None or lo is None or hi is None or lo > hi:
            out[p, i, lo, hi] = (None, None)
            continue
        found = [(b - a, o) for q, o, a, b in outer if q == p and o != i and a is not None and b is not None and a <= lo and b >= hi and a <= b]
        height, home = min(found, default=(None, None))
        out[p, i, lo, hi] = (home, height)
    return out


def random_ranges(rng, n, paths=3):
    rows = []
    for k in range(n):
        lo = rng.randint(0, 30)
        rows.append((f"p{rng.randrange(paths)}", f"i{k}", lo, lo + rng.choice([0, 0, 1, 3, 8, 20])))
    return rows


def test_innermost_equals_definition(spark):
    rng = random.Random(6)
    rows = random_ranges(rng, 400) + [(None, "n", 0, 5), ("p0", "u", None, 3), ("p0", "v", 4, None), ("p1", "inv", 9, 2)]
    outer = [r for r in rows if rng.random() < 0.6]
    got = I.innermost(spark.createDataFrame(rows + rows[:20], RANGE).repartition(3), spark.createDataFrame(outer, RANGE).repartition(3)).collect()
    assert len(got) == len(rows)
    assert {(r["path"], r["id"], r["lo"], r["hi"]): (r["container"], r["container_height"]) for r in got} == smallest(rows, outer)
    empty = spark.createDataFrame([], RANGE)
    assert I.innermost(empty, empty).count() == 0
    assert I.innermost(spark.createDataFrame(rows[:3], RANGE), empty).where("container is not null").count() == 0


def test_deep_nesting_is_not_quadratic(spark):
    n = 20000
    rows = spark.range(n).selectExpr("'f' as path", "cast(id as string) as id", "cast(id as int) as lo", f"cast({2 * n} - id as int) as hi")
    began = time.time()
    got = I.innermost(rows, rows).where("cast(container as int) = cast(id as int) - 1").count()
    assert got == n - 1
    assert time.time() - began < 20  # a join of all with all would make 2 * 10^8 rows


def test_stairs_keep_what_can_still_contain():
    s = Stairs()
    for end, key in ((100, (100, "a")), (50, (40, "b")), (50, (40, "c")), (60, (10, "d")), (50, (60, "e"))):
        s.add(end, key)
    assert s.find(55, None) == (10, "d") and s.find(50, None) == (10, "d") and s.find(70, None) == (100, "a") and s.find(101, None) is None
    assert s.find(60, "d") == (100, "a")
    s.forget(61)
    assert s.find(50, None) == (100, "a")


def test_own_range_and_equal_ranges(spark):
    rows = [("p", "a", 1, 9), ("p", "b", 1, 9), ("p", "c", 1, 9), ("p", "d", 2, 9)]
    df = spark.createDataFrame(rows, RANGE)
    assert {r["id"]: r["container"] for r in I.innermost(df, df).collect()} == {"a": "b", "b": "a", "c": "a", "d": "a"}


@pytest.mark.parametrize("seed", [1, 2])
def test_qualified_container_equals_definition(spark, seed):
    rng = random.Random(seed)
    made = []
    for k in range(150):
        sl, sc = rng.randint(0, 12), rng.randint(0, 6)
        el = sl + rng.choice([0, 0, 1, 4])
        made.append((f"p{k % 2}", k, sl, sc, el, rng.randint(sc, 9) if el == sl else rng.randint(0, 9)))
    outer = [r for r in made if rng.random() < 0.5]
    schema = "path string, id int, sl int, sc int, el int, ec int"
    got = {(r["path"], r["id"]): r["container"] for r in Y.qualified_container(spark.createDataFrame(made, schema), spark.createDataFrame(outer, schema)).collect()}
    for p, i, *r in made:
        b, e = tuple(r[:2]), tuple(r[2:])
        found = [(o[4] - o[2], o[5] - o[3], o[1]) for o in outer if o[0] == p and tuple(o[2:4]) <= b and tuple(o[4:]) >= e and (tuple(o[2:4]), tuple(o[4:])) != (b, e)]
        assert got[p, i] == (min(found)[2] if found else None)


def test_keys_may_be_several(spark):
    inner = spark.createDataFrame([("p", "x", None, 5, 5), ("p", "y", None, 5, 5), ("q", "x", None, 5, 5)], "path string, name string, id string, start long, stop long")
    outer = spark.createDataFrame([("p", "x", "s", 0, 9, 9), ("p", "x", "t", 4, 6, 2), ("q", "y", "u", 0, 9, 9)], "path string, name string, id string, start long, stop long, size long")
    got = {(r["path"], r["name"]): r["container"] for r in containers(inner, outer, ["path", "name"], ["size"]).collect()}
    assert got == {("p", "x"): "t", ("p", "y"): None, ("q", "x"): None}
