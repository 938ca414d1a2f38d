"""Version history of a working copy.

git runs where the working copy is, on the driver, and gives tables that are then written once (``snapshot``)
and read in parallel.
"""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

REVISION = re.compile(r"^[A-Za-z0-9_][A-Za-z0-9_./~^@{}-]*$")


def checked(revision: str) -> str:
    """Refuses what git could take for an option."""
    if not REVISION.match(revision) or ".." in revision:
        raise ValueError(f"not a revision: {revision!r}")
    return revision


def is_working_copy(root: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True, check=False).stdout.strip() == "true"


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def diff(spark: SparkSession, root: str, base: str = "HEAD", staged: bool = False) -> DataFrame:
    """(diff_id, text) of the working copy, or the index, against a revision, with renames found."""
    text = git(root, "diff", "--no-color", "--no-ext-diff", "-M", *(["--cached"] if staged else []), checked(base))
    return spark.createDataFrame([(base, text)], "diff_id string, text string")


def commits(spark: SparkSession, root: str, base: str = "HEAD") -> tuple[DataFrame, DataFrame]:
    """(commits(sha, ord, author_mail, author_time, is_merge), commit_files(sha, path)); ord grows with time."""
    log = git(root, "log", "--topo-order", "--reverse", "--format=%x00%H%x1f%ae%x1f%at%x1f%P", "--name-only", "--no-renames", "--root", checked(base))
    heads, files = [], []
    for i, entry in enumerate(log.split("\0")[1:]):
        head, *names = entry.split("\n")
        sha, mail, time, parents = head.split("\x1f")
        heads.append((sha, i, mail or None, int(time), len(parents.split()) > 1))
        files += [(sha, n) for n in names if n]
    return (
        spark.createDataFrame(heads, "sha string, ord long, author_mail string, author_time long, is_merge boolean"),
        spark.createDataFrame(files, "sha string, path string"),
    )


def blame(spark: SparkSession, root: str, paths: list[str], base: str = "HEAD", moved: bool = False, copied: bool = False, tasks: int = 8) -> DataFrame:
    """(path, ln, sha, author_mail, author_time): 0-based lines. Files are blamed in parallel by tasks; the working copy
    must lie where they can read it."""
    options, rev = [*(["-M"] if moved else []), *(["-C"] if copied else [])], checked(base)

    def run(batches):
        for b in batches:
            rows = []
            for p in b["path"]:
                sha = ln = mail = None
                for line in git(root, "blame", "--line-porcelain", *options, rev, "--", p).split("\n"):
                    if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line):
                        sha, ln = m[1], int(m[2]) - 1
                    elif line.startswith("author-mail "):
                        mail = line[12:].strip("<>")
                    elif line.startswith("author-time "):
                        rows.append((p, ln, sha, mail, int(line[12:])))
            yield pd.DataFrame(rows, columns=["path", "ln", "sha", "author_mail", "author_time"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(tasks, len(paths))))
    return listed.mapInPandas(run, "path string, ln int, sha string, author_mail string, author_time long")


def blob(spark: SparkSession, root: str, revision: str, path: str) -> DataFrame:
    """(rev, path, text) of a file at a revision; no row if it isn't there."""
    try:
        rows = [(revision, path, git(root, "show", f"{checked(revision)}:{path}"))]
    except subprocess.CalledProcessError:
        rows = []
    return spark.createDataFrame(rows, "rev string, path string, text string")


def snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
