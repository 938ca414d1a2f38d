"""All thresholds in one place."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Most bytes, counted, of a side that joins inside ``measured_joins`` broadcast.
MEASURED_BROADCAST = "2MB"


@dataclass(frozen=True)
class CoChangeConfig:
    min_confidence: float = 0.3
    min_score: float = 0.0
    min_samples: int = 2
    max_source_files: int = 500
    max_files_per_commit: int = 100
    pivot: int = 8
    alpha: float = 1.0
    beta: float = 8.0
    smoothing: bool = True
    min_denominator: int = 2
    per_source_limit: int = 10
    history_limit: int = 20
    author_window_days: int = 7


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Without it a folder of our own, if driver and executors are one process;
    on a cluster an error, for its machines would each write to their own disk."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside broadcasts a side of a join for its counted bytes alone, or by a hint. An estimate starts at the size of
    compressed files and is carried on by checkpoints, so tables that grow with the input look small, and each broadcast of one goes whole through the driver."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": MEASURED_BROADCAST}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def held(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder, for plans that read it several times: each would make it anew."""
    folder = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
