"""Reading files under a time limit each, and what was read, counted on the way.

A file that takes too long or makes its reader fail costs its limit and one row among the errors; it neither stops the job nor hides the rows
of others. Rows and errors are written once to the folder that the cluster shares, so that the files are read once however often the two
are asked for; the totals are metrics of that one pass (``Observation``), not a second one.
"""

from __future__ import annotations

import signal
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import shared_folder

SECONDS = 10.0
#: Rows of a frame that a reader hands over at once.
FRAME_ROWS = 20_000


class TooLate(Exception):
    pass


@contextmanager
def within(seconds: float) -> Iterator[None]:
    """Raises TooLate after so many seconds, by the alarm clock of the worker's main thread: between steps of Python and inside regular
    expressions; what a C parser does in one step ends first."""

    def ring(*_):
        raise TooLate

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def frames(rows: Iterable[tuple], names: list[str], dtype: type | None = None) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most ``FRAME_ROWS``, so that a worker holds no more of them than that, however many a batch of files has."""
    for some in batched(rows, FRAME_ROWS):
        yield pd.DataFrame(list(some), columns=names, dtype=dtype)


def read_within(files: DataFrame, reader: Callable[[str, str, str], list[tuple]], schema: str, seconds: float = SECONDS) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(rows, errors, totals) of ``reader`` over (path, lang, text) files.

    ``reader`` gives a file's rows in the order of ``schema``, whose first column is the path. errors has (path, lang, error), error
    ``timeout`` or the failure's name; totals has files (with a text and a language), passed_over (the others), rows,
    timeouts and failures. A file's rows come whole or not at all.
    """
    spark = files.sparkSession
    names = [c.split()[0] for c in schema.split(", ")]
    extra = ["lang_", "error_", "files_", "passed_"]

    def one(path: str, lang: str | None, text: str | None) -> tuple[list[tuple], tuple]:
        if lang is None or text is None:
            return [], (path, lang, None, 0, 1)
        try:
            with within(seconds):
                return [*reader(path, lang, text)], (path, lang, None, 1, 0)
        except TooLate:
            return [], (path, lang, "timeout", 1, 0)
        except Exception as e:  # a reader may fail in any way on a file that no one wrote it for; the error is a row
            return [], (path, lang, type(e).__name__, 1, 0)

    def told(batches):
        for b in batches:
            for p, g, t in zip(b["path"], b["lang"], b["text"], strict=True):
                found, note = one(p, g, t)
                for r in found:
                    yield *r, None, None, None, None
                yield note[0], *[None] * (len(names) - 1), *note[1:]

    def run(batches):
        for frame in frames(told(batches), [*names, *extra], object):
            yield frame.where(lambda d: d.notna(), None)

    seen = Observation()
    counted = lambda c: F.count(F.when(c, 1))
    every = files.select("path", "lang", "text").mapInPandas(run, f"{schema}, lang_ string, error_ string, files_ int, passed_ int").observe(
        seen, F.coalesce(F.sum("files_"), F.lit(0)).alias("files"), F.coalesce(F.sum("passed_"), F.lit(0)).alias("passed_over"), counted(F.col("files_").isNull()).alias("rows"),
        counted(F.col("error_") == "timeout").alias("timeouts"), counted(F.col("error_") != "timeout").alias("failures"),
    )
    folder = f"{shared_folder(spark)}/read-{uuid.uuid4().hex}"
    every.write.parquet(folder)
    held = spark.read.schema(every.schema).parquet(folder)
    errors = held.where("error_ is not null").select(F.col(names[0]).alias("path"), F.col("lang_").alias("lang"), F.col("error_").alias("error"))
    return held.where("files_ is null").select(*names), errors, {k: int(v) for k, v in seen.get.items()}
