"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable. Nodes are those of the edges.

    A round takes the smallest label among a node's neighbours, then that label's own label, so stars take
    two rounds and chains a logarithmic number. Sums and minima combine before they are shuffled; the joins are
    plain equi-joins whose skewed partitions adaptive execution splits. Null ends are no nodes.
    """
    kept = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = materialize(kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "low").alias("next"))
        step = materialize(step, "step")
        of = step.select(F.col("node").alias("at"), F.col("next").alias("jump"))
        jumped = step.join(of, step["next"] == of["at"], "left").select("node", F.col("label").alias("was"), F.least("next", F.coalesce("jump", "next")).alias("label"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("was <> label").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"no fix point after {most_rounds} rounds")
