"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent alpha in 0..1 and normalised; 1 keeps the shares, 0
makes all sources equal. Bisection finds the largest alpha (the smallest for an entropy target) that meets the
target: no source repeated more than ``max_repeats`` times, or an entropy of at least ``min_entropy`` nats. A
source's quota is its weight times the budget. Without a budget it is the smallest one that holds every record
once, so nothing is dropped and sources are only repeated.

A quota is realised block by block. A block is one pass over a source in the order of a hash of (block,
record), so each block is another permutation; whole blocks take all records, the last takes records in order
while their tokens fit what is left. What decides is one key a source: records up to it are in. To find it,
tokens are summed by source and the hash's first three hex digits, prefix sums over these 4096 sums say in
which the quota ends, and only that one is looked into row by row. So no window holds a source, texts are not
shuffled, and the only thing joined to the records is a row a source.

Tokens are words (``[^\\x20\\x09-\\x0D]+``). Dirty input. Null and empty texts have no tokens; a null source is
a source of its own; a source without tokens is kept once and has weight 0; null ids hash as the word null;
rows of one source with equal ids are taken or left together; an empty table gives no rows. Column names of
the input that clash with those added (block, order_key, weight) are refused with a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

MAX_REPEATS = 2.0
STEPS = 60
DIGITS = 3
#: Sources up to this number are broadcast (a row each), more are joined by shuffling.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def block_key(block: Column, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat_ws(":", block.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def bisect(reaches, steps: int = STEPS) -> Column:
    """The largest alpha in 0..1 at which ``reaches(alpha)`` still holds, when it holds below and not above."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def half(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        ok = reaches(mid)
        return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half)["lo"]


def entropy(sizes: Column, alpha: Column) -> Column:
    """Of the normalised sizes ** alpha, in nats: log Z - sum(p^a log p^a) / Z."""
    total = lambda f: F.aggregate(sizes, F.lit(0.0), lambda a, s: a + f(s))
    z = total(lambda s: F.pow(s, alpha))
    return F.log(z) - total(lambda s: F.pow(s, alpha) * alpha * F.log(s)) / z


def weights(sizes: DataFrame, max_repeats: float | None = MAX_REPEATS, min_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, weight, repeats) from (source, tokens). ``repeats`` is the quota over the tokens.

    At exponent alpha the smallest source is repeated (largest / smallest) ** (1 - alpha) times for each time
    of the largest, which falls as alpha grows; entropy falls too. With an entropy target the sizes, one double
    a source, meet in one row.
    """
    used = sizes.where("tokens > 0")
    if min_entropy is not None:
        gathered = used.agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("all"))
        alpha = gathered.select(bisect(lambda a: entropy(F.transform("all", lambda s: s / F.array_max("all")), a) >= min_entropy).alias("alpha"))
    else:
        ends = used.agg(F.max("tokens").cast("double").alias("most"), F.min("tokens").cast("double").alias("least"))
        over = bisect(lambda b: F.pow(F.col("most") / F.col("least"), b) <= max_repeats)  # b = 1 - alpha
        alpha = ends.select((1 - F.coalesce(over, F.lit(0.0))).alias("alpha"))
    powered = sizes.crossJoin(F.broadcast(alpha)).withColumn("p", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.col("alpha"))).otherwise(0.0))
    z = powered.agg(F.sum("p").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("p"))).alias("cover"))
    quota = F.col("cover") if budget is None else F.lit(float(budget)) / F.col("z")
    out = powered.crossJoin(F.broadcast(z)).withColumn("repeats", F.when(F.col("tokens") > 0, F.round(quota * F.col("p") / F.col("tokens"), 9)).otherwise(1.0))
    return out.select("source", "tokens", F.round(F.coalesce(F.col("p") / F.col("z"), F.lit(0.0)), 9).alias("weight"), "repeats")


def plan(narrow: DataFrame, max_repeats: float | None = MAX_REPEATS, min_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, weight, whole, last_key): whole blocks, and the last key of the block after them, null for none.

    ``narrow``: (doc_id, source, n_tokens), read three times.
    """
    sizes = narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    quotas = weights(sizes, max_repeats, min_entropy, budget).select(
        F.col("source").alias("s"), "weight", F.floor("repeats").cast("int").alias("whole"), F.floor((F.col("repeats") - F.floor("repeats")) * F.col("tokens") + 0.5).alias("left")
    )
    quotas = materialize(quotas, "quotas")
    small = quotas.count() <= BROADCAST_SOURCES
    quotas = F.broadcast(quotas) if small else quotas
    keyed = narrow.join(quotas, F.col("source").eqNullSafe(F.col("s"))).where("left > 0").withColumn("key", block_key(F.col("whole")))
    drawn = keyed.select("s", "left", "key", "n_tokens", F.substring("key", 1, DIGITS).alias("head"))
    sums = drawn.groupBy("s", "head").agg(F.sum("n_tokens").alias("n"), F.max("left").alias("left"), F.max("key").alias("top"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("head").rowsBetween(Window.unboundedPreceding, 0))
    sums = materialize(sums.withColumn("upto", upto), "heads")
    whole_heads = sums.where("upto <= left").groupBy("s").agg(F.max("top").alias("last"))
    ends = sums.where("upto > left and upto - n <= left").select(F.col("s").alias("es"), F.col("head").alias("eh"), (F.col("upto") - F.col("n")).alias("before"))
    inside = drawn.join(F.broadcast(ends) if small else ends, F.col("s").eqNullSafe(F.col("es")) & (F.col("head") == F.col("eh")))
    inside = inside.groupBy("s", "key").agg(F.sum("n_tokens").alias("n"), F.max("left").alias("left"), F.max("before").alias("before"))
    sofar = F.sum("n").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    rows = inside.withColumn("sofar", sofar).where("sofar <= left").groupBy("s").agg(F.max("key").alias("last"))
    last = whole_heads.unionByName(rows).groupBy(F.col("s").alias("ls")).agg(F.max("last").alias("last_key"))
    return quotas.join(last, F.col("s").eqNullSafe(F.col("ls")), "left").select(F.col("s").alias("source"), "weight", "whole", "last_key")


def drawn(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df``'s rows once a block that takes them, with block, order_key and weight. Sorted by (block,
    order_key) within a source they are in the order drawn."""
    if clash := {"block", "order_key", "weight"} & {*df.columns}:
        raise ValueError(f"columns {sorted(clash)} are in the input")
    few = materialize(of.select(F.col("source").alias("__source"), "weight", F.col("whole").alias("__whole"), F.col("last_key").alias("__last")), "mix")
    few = F.broadcast(few) if few.count() <= BROADCAST_SOURCES else few
    more = F.coalesce(block_key(F.col("__whole")) <= F.col("__last"), F.lit(False)).cast("int")
    times = F.col("__whole") + more
    rows = df.join(few, F.col("source").eqNullSafe(F.col("__source"))).where(times > 0)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), times - 1)))
    return rows.withColumn("order_key", block_key(F.col("block"))).select(*[F.col(f"`{c}`") for c in df.columns], "block", "order_key", "weight")


def counted(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", tokens().alias("n_tokens")), "tokens")


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with sources repeated up to 2 times, to the temperature that this allows."""
    narrow = counted(table(spark, sf_dir, "documents"))
    return drawn(narrow, plan(narrow))


OP4_SQL = r"""
    WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
    sizes AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
    ends AS (SELECT CAST(max(tokens) AS DOUBLE) AS most, CAST(min(tokens) AS DOUBLE) AS least FROM sizes WHERE tokens > 0),
    b(i, lo, hi) AS (
        SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
        UNION ALL
        SELECT i + 1, CASE WHEN pow(most / least, (lo + hi) / 2) <= 2.0 THEN (lo + hi) / 2 ELSE lo END,
               CASE WHEN pow(most / least, (lo + hi) / 2) <= 2.0 THEN hi ELSE (lo + hi) / 2 END
        FROM b, ends WHERE i < 60),
    p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(CAST(tokens AS DOUBLE), 1 - lo) ELSE 0 END AS p FROM sizes, b WHERE i = 60),
    z AS (SELECT sum(p) AS z, max(CASE WHEN tokens > 0 THEN tokens / p END) AS cover FROM p),
    w AS (SELECT source, tokens, round(coalesce(p / z, 0), 9) AS weight, CASE WHEN tokens > 0 THEN round(cover * p / tokens, 9) ELSE 1 END AS repeats FROM p, z),
    q AS (SELECT source, weight, CAST(floor(repeats) AS INTEGER) AS whole, CAST(floor((repeats - floor(repeats)) * tokens + 0.5) AS BIGINT) AS lft FROM w),
    k AS (SELECT d.*, weight, whole, lft, md5(concat(whole, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
    c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= lft AND lft > 0 AS more FROM k)
    SELECT doc_id, source, n_tokens, CAST(block AS INTEGER) AS block, md5(concat(block, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS order_key, weight
    FROM (SELECT *, unnest(range(whole + CAST(more AS INTEGER))) AS block FROM c)
"""


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents, those of small sources repeated; nothing is left out."""
    return drawn(docs, plan(counted(docs))).select(*docs.columns)
