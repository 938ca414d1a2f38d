"""Sharding over fixed virtual slots.

Records hash into ``n_slots`` slots. The only thing that decides where a record lives is the slot map, a
table (version, slot, shard, bytes, rows) of exactly ``n_slots`` rows a version. Version 1 deals the slots
round robin; rebalancing writes the next version, in which only those slots move that a shard holds beyond
the mean. Nothing but the map (its size fixed by ``n_slots``) is ever gathered or broadcast.

Dirty input. Null text counts as no bytes (size ``overhead``, crc32 of nothing: 0) and empty text the same;
null ids hash like a value of their own together with the text; repeated rows are separate rows that share a
slot; an empty table gives an empty result and a map whose slots hold 0 bytes; columns of the input other
than the id and the text are never looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

N_SLOTS = 4096
SHARDS = 40
OVERHEAD = 16
#: A shard keeps its largest slots up to this share of the mean; the small rest levels the shards.
KEEP = 0.9


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, vslot): all that sharding needs of a record."""
    text = F.col(text_col)
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_bytes(sized_df: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): summed before the shuffle, so a task sends n_slots rows at most."""
    return sized_df.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def initial_map(spark: SparkSession, shards: int = SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, load: DataFrame, shards: int = SHARDS, keep: float = KEEP) -> DataFrame:
    """The next version of ``slot_map`` for the loads in ``load``.

    Each shard keeps its slots, largest first, while they fit within ``keep`` of the mean; the released
    slots go, largest first, to the shard that holds least by then. One row of n_slots structs is the most
    that meets in one task. Slots of shards beyond ``shards`` are all released, so this also shrinks a map;
    new shards start empty, so it also grows one.
    """
    now = slot_map.join(load, "vslot", "left").select(
        "version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    mean = now.agg((F.sum("bytes") / F.lit(shards)).alias("mean"))
    kept = (
        now.withColumn("upto", F.sum("bytes").over(by_size))
        .crossJoin(F.broadcast(mean))
        .withColumn("held", (F.col("shard") < shards) & (F.col("upto") <= F.col("mean") * keep))
    )
    start = F.array(*[F.coalesce(F.sum(F.when(F.col("held") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)) for s in range(shards)])
    freed = F.sort_array(F.collect_list(F.when(~F.col("held"), F.struct((-F.col("bytes")).alias("neg"), F.col("vslot").alias("vslot")))))
    plan = kept.agg(start.alias("loads"), freed.alias("freed"))

    def place(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"]))
        loads = F.transform(acc["loads"], lambda x, i: F.when(i + 1 == at, x - slot["neg"]).otherwise(x))
        moved = F.concat(acc["moved"], F.array(F.struct(slot["vslot"].alias("vslot"), (at - 1).cast("int").alias("to"))))
        return F.struct(loads.alias("loads"), moved.alias("moved"))

    none = F.expr("cast(array() as array<struct<vslot:int,to:int>>)")
    moves = plan.select(
        F.explode(F.aggregate("freed", F.struct(F.col("loads").alias("loads"), none.alias("moved")), place)["moved"]).alias("m")
    ).select("m.vslot", "m.to")
    return kept.join(moves, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"), "bytes", "rows"
    )


def place(sized_df: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard, and its gapless place in that shard.

    The place is the sum of the rows in the shard's earlier slots (a prefix sum over the map) plus the rank
    inside the record's own slot, so no task sorts more than the slots it was dealt.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("vslot", "shard", "version", "offset")
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        sized_df.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "vslot")  # n_slots rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed records, stored slot map with both versions)."""
    spark = docs.sparkSession
    records = sized(docs, n_slots=n_slots)
    load = slot_bytes(records)
    first = initial_map(spark, shards, n_slots)
    second = materialize(rebalance(first, load, shards).coalesce(1), "slot-map-v2")
    stored = first.join(second.select("vslot", "bytes", "rows"), "vslot").select(*second.columns).unionByName(second)
    return place(records, second), stored


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``bytes``."""
    placed, _ = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
