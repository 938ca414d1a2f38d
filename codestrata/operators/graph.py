"""Fix points over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ensure_checkpoints


def more(seen: DataFrame, new: DataFrame) -> DataFrame:
    """Both as one checkpointed table of no more partitions than the larger has: a walk that only adds them up runs, after k rounds,
    k times the tasks in each round and sends their results to the driver."""
    most = max(seen.rdd.getNumPartitions(), new.rdd.getNumPartitions(), 1)
    return seen.unionByName(new).coalesce(most).checkpoint()


def closure(edges: DataFrame, roots: DataFrame | None = None, most_rounds: int | None = None) -> DataFrame:
    """(src, dst, depth): all reachable pairs of (src, dst) edges, or those from ``roots`` (node), each at its
    smallest depth. Frontier by frontier; a pair met before is not walked again, so cycles end, and so does the walk, however
    deep, unless ``most_rounds`` bounds it. Each round's frontier and all that is found are checkpointed: a round reads one table."""
    ensure_checkpoints(edges.sparkSession)
    e = edges.select("src", "dst").distinct()
    frontier = e.select("src", "dst", F.lit(1).alias("depth"))
    if roots is not None:
        frontier = frontier.join(roots.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    seen = frontier = frontier.checkpoint()
    depth = 1
    while True:
        depth += 1
        if most_rounds is not None and depth > most_rounds:
            raise RuntimeError(f"no fix point after {most_rounds} rounds")
        step = frontier.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            return seen
        seen = more(seen, frontier)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (src, dst) edges that lie on cycles of several nodes, named by the greatest node of
    each; every other node is a component of its own. Nodes without ways in or out are put aside, then the greatest name that reaches
    a node colours it, and what reaches the node of its colour's name is a component; all that is left goes round again."""
    ensure_checkpoints(edges.sparkSession)
    rest = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct().checkpoint()
    found = rest.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        size = rest.count()
        while size:
            ins, outs = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
            rest = rest.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst").checkpoint()
            before, size = size, rest.count()
            if size == before:
                break
        if not size:
            return found
        colour = rest.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")).checkpoint()
        new = colour
        while not new.isEmpty():
            told = rest.join(new.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("told"))
            both = colour.join(told, "node", "left").withColumn("new", F.coalesce(F.col("told") > F.col("colour"), F.lit(False)))
            both = both.select("node", F.when(F.col("new"), F.col("told")).otherwise(F.col("colour")).alias("colour"), "new").checkpoint()
            colour, new = both.select("node", "colour"), both.where("new").select("node", "colour")
        side = lambda name: colour.select(F.col("node").alias(name), F.col("colour").alias(f"{name}_colour"))
        inside = rest.join(side("src"), "src").join(side("dst"), "dst").where("src_colour = dst_colour").select("src", "dst").checkpoint()
        part = new = colour.where("node = colour").checkpoint()
        while not new.isEmpty():
            back = inside.join(new.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            new = back.join(part.select("node"), "node", "left_anti").checkpoint()
            part = more(part, new)
        found = found.unionByName(part.withColumnRenamed("colour", "component")).checkpoint()
        gone = part.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst").checkpoint()


def live(named: DataFrame, wildcard: DataFrame, roots: DataFrame) -> DataFrame:
    """(module, name) that roots make visible: a root (module, name) is live; a named edge (module, name, to, as)
    passes one name on, a wildcard edge (module, to) all names of the module."""
    ensure_checkpoints(roots.sparkSession)
    seen = frontier = roots.select("module", "name").distinct().checkpoint()
    while True:
        a = frontier.join(named, ["module", "name"]).select(F.col("to").alias("module"), F.col("as").alias("name"))
        b = frontier.join(wildcard, "module").select(F.col("to").alias("module"), "name")
        frontier = a.unionByName(b).distinct().join(seen, ["module", "name"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = more(seen, frontier)


def participants(edges: DataFrame) -> DataFrame:
    """(name, first_seq): who takes part in (seq, caller, callee) edges, by first appearance."""
    both = edges.select("seq", F.lit(0).alias("side"), F.col("caller").alias("name")).unionByName(edges.select("seq", F.lit(1).alias("side"), F.col("callee").alias("name")))
    return both.groupBy("name").agg(F.min(F.struct("seq", "side")).alias("first")).select("name", F.col("first.seq").alias("first_seq"), F.col("first.side").alias("first_side"))
