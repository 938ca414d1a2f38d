"""Files that Spark's listing leaves out: those below a name that begins with an underscore or a dot.

A tree's first level is listed by one task, each folder below it by a task of its own, and contents are read in tasks spread over
paths, a few megabytes at a time. Where the tree is no local folder, its address must be one that Arrow can open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_IN_FRAME = 8 << 20


def _open(root: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)


def _listed(root: str, folder: str, recursive: bool) -> pd.DataFrame:
    from pyarrow import fs

    system, base = _open(root)
    base = base.rstrip("/")
    infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=recursive))
    rows = [(i.path[len(base) + 1 :], i.type == fs.FileType.Directory, i.size or 0) for i in infos if i.type in (fs.FileType.File, fs.FileType.Directory)]
    return pd.DataFrame(rows, columns=["rel", "folder", "length"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel, length) of all files below ``root``, whatever their names."""
    root = re.sub(r"^file:/+", "/", root.rstrip("/"))

    def below(recursive: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for folder in frame["rel"]:
                    yield _listed(root, folder, recursive)

        return run

    schema = "rel string, folder boolean, length long"
    top = spark.range(1, numPartitions=1).select(F.lit("").alias("rel")).mapInPandas(below(False), schema)
    # .git holds no sources, and most of a tree's files.
    deep = top.where("folder and rel <> '.git'").select("rel").repartition("rel").mapInPandas(below(True), schema)
    return top.unionByName(deep).where("not folder").select("rel", "length")


def contents(files: DataFrame, root: str) -> DataFrame:
    """(rel, content, length) of listed files; those that are gone by then are left out."""
    root = re.sub(r"^file:/+", "/", root.rstrip("/"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)
        made = lambda rows: pd.DataFrame(rows, columns=["rel", "content", "length"])
        rows, held = [], 0
        for frame in frames:
            for rel in frame["rel"]:
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{rel}") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                rows.append((rel, data, len(data)))
                held += len(data)
                if held >= MOST_IN_FRAME:
                    yield made(rows)
                    rows, held = [], 0
        yield made(rows)

    return files.select("rel").repartition("rel").mapInPandas(run, "rel string, content binary, length long")
