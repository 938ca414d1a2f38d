"""Shared pieces: table reading, scratch tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import shared_folder

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is planned and run inside when that ends, not when the driver happens
    to collect garbage. Until then they outlive lost tasks as ever; whoever runs the same plan again makes them anew."""
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cuts lineage with a written table: every later reader sees the same rows, and a lost executor
    costs a reread rather than a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def commonest(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, ``most`` of them at the utmost, without sorting: a histogram of the
    counts' logarithms, of fixed size, gives the least count that goes in. A bucket goes in whole or not."""
    bucket = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    bars = df.where(F.col(count) > 0).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, total = None, 0
    for bar in sorted(bars, key=lambda b: -b["bucket"]):
        total += bar["rows"]
        if total > most:
            break
        least = bar["bucket"]
    return df.where(F.lit(False)) if least is None else df.where((F.col(count) > 0) & (bucket >= least))


def lowest(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """The ``n`` rows with the lowest ``key``, an even long such as a hash, of about ``total``. Rows too high to
    be among them go first, so that the driver is sent about n rows, not n from every partition."""
    share = 1.5 * n / max(1, total)
    shifted = F.shiftrightunsigned(key, 1)  # 0 .. 2^63 - 1, in the order of the key's bits
    return (df if share >= 0.5 else df.where(shifted < int(share * 2**63))).orderBy(shifted, *df.columns).limit(n)
