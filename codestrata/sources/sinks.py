"""Outputs: answers in input order, a store of results by content, what the engine can do."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

VERSION = "1"


def ordered_lines(answers: DataFrame, ord_: str = "ord", prefetch: bool = True) -> Iterator[str]:
    """Rows as JSON lines in order of a column, a partition at a time: the driver never holds all of them."""
    rows = answers.orderBy(ord_).select(F.to_json(F.struct(*[c for c in answers.columns if c != ord_])).alias("line"))
    return (r["line"] for r in rows.toLocalIterator(prefetchPartitions=prefetch))


def content_key(*parts: Column) -> Column:
    """A key of the engine's version and the parts, which no concatenation of others can give."""
    return F.sha2(F.concat_ws("\0", F.lit(VERSION), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


class Store:
    """Results by key as a Parquet folder. Each put adds files, so one that fails leaves nothing that is read: an entry
    counts if its check sum fits its value, and the first of several by value is taken."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("key string, value string, crc long").parquet(self.path)

    def _made(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def get(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((key, value) of hits, (key) of misses)."""
        keys = keys.select("key").distinct()
        if not self._made():
            return self.spark.createDataFrame([], "key string, value string"), keys
        sound = self._rows().where(F.crc32(F.col("value").cast("binary")) == F.col("crc")).join(keys, "key", "left_semi").groupBy("key").agg(F.min("value").alias("value"))
        return sound, keys.join(sound, "key", "left_anti")

    def put(self, rows: DataFrame) -> None:
        rows.select("key", "value", F.crc32(F.col("value").cast("binary")).alias("crc")).write.mode("append").parquet(self.path)


def capabilities(spark: SparkSession) -> DataFrame:
    """(language, backend, exact): how each language is read."""
    from ..operators.symbols import ALIKE, DECLARATIONS

    rows = [(lang, "grammar" if lang == "python" else "patterns" if ALIKE.get(lang, lang) in DECLARATIONS else "none", lang == "python") for lang in P.EXTENSIONS]
    return spark.createDataFrame(rows, "language string, backend string, exact boolean")
