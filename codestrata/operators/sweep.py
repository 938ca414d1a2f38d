"""Innermost containment by one sorted pass.

Ranges are dealt by their keys (a path, or a path and a name), sorted by start in their partition, and read once. What is
held is a staircase of the ranges that can still be somebody's container: by falling end and falling rank, so the
smallest rank among those that reach far enough is found by bisection. For nested ranges that is the stack of open ones. Time
grows with n log n and memory with the depth of nesting, where a join of all ranges of a file with all grows with n^2.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns are positions of lines and columns in one long.
LINE = 1 << 32


def spot(line: Column | str, col: Column | str) -> Column:
    """A place as one long, in order of the text."""
    as_long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    return as_long(line) * LINE + as_long(col)


class Stairs:
    """Open ranges. ``ends`` holds negated ends, rising; ``best`` the two smallest (rank..., id) of each end, falling."""

    __slots__ = ("ends", "best")

    def __init__(self):
        self.ends, self.best = [], []

    def add(self, end: int, key: tuple) -> None:
        at = bisect_right(self.ends, -end)
        if at and self.ends[at - 1] == -end:
            two = [k for k in self.best[at - 1] if k != key] + [key]
            self.best[at - 1] = sorted(two)[:2]
            at -= 1
        elif at and self.best[at - 1][0] <= key:
            return  # one that reaches farther is better
        else:
            self.ends.insert(at, -end)
            self.best.insert(at, [key])
        last = at + 1
        while last < len(self.ends) and self.best[last][0] >= self.best[at][0]:
            last += 1
        del self.ends[at + 1 : last], self.best[at + 1 : last]

    def forget(self, start: int) -> None:
        while self.ends and -self.ends[-1] < start:
            self.ends.pop()
            self.best.pop()

    def find(self, end: int, own) -> tuple | None:
        at = bisect_right(self.ends, -end) - 1
        if at < 0:
            return None
        if self.best[at][0][-1] != own:
            return self.best[at][0]
        rest = self.best[at][1:2] + (self.best[at - 1][:1] if at else [])
        return min(rest, default=None)


def containers(inner: DataFrame, outer: DataFrame, keys: list[str], ranks: list[str]) -> DataFrame:
    """``keys``, id, start, stop, container and ``ranks``: each inner range with the id and ranks of the outer one of
    smallest ranks, then id, that contains it.

    ``inner`` has the keys, id, start and stop, ``outer`` also the ranks; start, stop and ranks are longs, ids of one
    type. Ends count as inside. A range doesn't contain that of its own id, which is unique within the keys and
    stands for one range. Without a container, with a null key, start or stop, and for a stop before the start the container is null;
    outer ranges like that contain nothing. Repeated inner rows give one.
    """
    null = F.lit(None).cast("long")
    usable = F.col("start") <= F.col("stop")
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    asked = inner.select(*keys, "id", F.col("start").cast("long"), F.col("stop").cast("long"), F.lit(1).alias("side"), *[null.alias(r) for r in ranks])
    held = outer.select(*keys, "id", F.col("start").cast("long"), F.col("stop").cast("long"), F.lit(0).alias("side"), *[F.col(r).cast("long").alias(r) for r in ranks]).where(usable)
    rows = held.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "start", "side", "stop", "id")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*keys, "id")}
    names = [*keys, "id", "start", "stop", "container", *ranks]
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"id {kinds['id']}, start long, stop long, container {kinds['id']}", *(f"`{r}` long" for r in ranks)])

    def run(batches):
        key, stairs, last = None, Stairs(), None
        for b in batches:
            lists = [b.column(c).to_pylist() for c in keys]
            ids, starts, stops, sides = (b.column(c).to_pylist() for c in ("id", "start", "stop", "side"))
            weights = list(zip(*(b.column(r).to_pylist() for r in ranks), strict=True))
            places, found = [], []
            for i, now in enumerate(zip(*lists, strict=True)):
                if now != key:
                    key, stairs, last = now, Stairs(), None
                start, stop, own = starts[i], stops[i], ids[i]
                if not sides[i]:
                    stairs.forget(start)
                    stairs.add(stop, (*weights[i], own))
                elif last != (start, stop, own):
                    last = start, stop, own
                    places.append(i)
                    if start is None or stop is None or start > stop or None in now:
                        found.append(None)
                    else:
                        stairs.forget(start)
                        found.append(stairs.find(stop, own))
            if places:
                at = pa.array(places)
                kept = [b.column(c).take(at) for c in (*keys, "id", "start", "stop")]
                home = pa.array([f and f[-1] for f in found], b.schema.field("id").type)
                yield pa.RecordBatch.from_arrays([*kept, home, *[pa.array([f and f[k] for f in found], pa.int64()) for k in range(len(ranks))]], names=names)

    return rows.mapInArrow(run, fields)
