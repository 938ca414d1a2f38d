"""Removed names that were never part of an interface, though their signatures count as exported.

Three rules, each by joins of the removed names with the lines of the old files and the references in the new tree:

- ``shell``: functions of shell files reach other processes only by ``export -f`` (``declare -fx``, ``declare -xf``). One that isn't exported
  and that nothing names any more is gone quietly: where the whole file went, no shell file may name it; where the file stays, no
  file of the tree, and the file must have gained nothing (else ``replaced`` decides).
- ``replaced``: the file gained other names and nothing in the tree names the old one: renamed with its use.
- ``script``: a Python file at the root that went as a whole was run, not imported: no Python file of the new tree names its module, and the
  old project file makes no command of it. A project file that can't be read, or whose commands can't, makes commands of all.

Dirty input. Null texts have no lines, rows with a null name or file stay without a reason, repeated rows are answered once.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings of shell files, and how a function is exported.
SHELL = r"\.(sh|bash|zsh)$"
EXPORTS = r"^\s*(?:export -f |declare -fx |declare -xf )(.*)$"


def shell_exports(files: DataFrame) -> DataFrame:
    """(file, name) of the functions that shell files (path, text) export."""
    line = files.where(F.col("path").rlike(SHELL)).select(F.col("path").alias("file"), F.explode(F.split("text", r"\r?\n")).alias("line"))
    names = line.select("file", F.explode(F.split(F.trim(F.regexp_extract("line", EXPORTS, 1)), r"\s+")).alias("name"))
    return names.where("name <> ''").distinct()


def _commands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for text in frame["text"]:
            try:
                whole = tomllib.loads(text)
                tables = [whole.get("project", {}).get(k) for k in ("scripts", "gui-scripts")]
                tables.append(whole.get("tool", {}).get("poetry", {}).get("scripts"))
                targets = [v for t in tables if t is not None for v in t.values()]
                if not all(isinstance(v, str) for v in targets):
                    raise TypeError("a command that is no text")
            except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                found.append(None)
                continue
            found += [part for v in targets for part in {v.split(":")[0], v.split(":")[0].split(".")[0]}]
        yield pd.DataFrame({"module": pd.Series(found, dtype=object)})


def script_commands(files: DataFrame) -> DataFrame:
    """(module) that the root's project file makes commands of; a row with null stands for every module."""
    return files.where("path = 'pyproject.toml' and text is not null").select("text").mapInPandas(_commands, "module string").distinct()


def script_modules(files: DataFrame) -> DataFrame:
    """(file, module) of the Python files at the root that stand for themselves."""
    module = F.regexp_extract("path", r"^([^/]+)\.py$", 1)
    return files.select(F.col("path").alias("file"), module.alias("module")).where("module not in ('', '__init__')").distinct()


def outside_surface(removed: DataFrame, old_files: DataFrame, kept_files: DataFrame, gained: DataFrame, named: DataFrame) -> DataFrame:
    """(name, file, reason) of the removed (name, file)s that no caller can miss.

    ``old_files`` (path, text) are the old side's files, the root's project file with them; ``kept_files`` (path) those that the new tree
    still has; ``gained`` (file) those that got new names; ``named`` (name, path) says which files of the new tree name what: removed
    names and the modules of removed scripts.
    """
    rows = removed.where("name is not null and file is not null").select("name", "file").distinct()
    keeps = kept_files.select(F.col("path").alias("file"), F.lit(True).alias("keeps")).distinct()
    more = gained.select("file", F.lit(True).alias("gains")).distinct()
    seen = named.groupBy("name").agg(F.lit(True).alias("anywhere"), F.bool_or(F.col("path").rlike(SHELL)).alias("in_shell"), F.bool_or(F.col("path").endswith(".py")).alias("in_python"))
    commands = script_commands(old_files)
    # One row at most stands for every module.
    every = commands.where("module is null").agg((F.count(F.lit(1)) > 0).alias("all_commands"))
    scripts = script_modules(old_files).join(kept_files.select(F.col("path").alias("file")), "file", "left_anti")
    scripts = scripts.join(commands.where("module is not null"), "module", "left_anti").join(seen.where("in_python").select(F.col("name").alias("module")), "module", "left_anti")
    scripts = scripts.crossJoin(F.broadcast(every)).where("not all_commands").select("file", F.lit(True).alias("script")).distinct()
    exported = shell_exports(old_files).withColumn("exports", F.lit(True))
    rows = rows.join(keeps, "file", "left").join(more, "file", "left").join(scripts, "file", "left").join(exported, ["file", "name"], "left").join(seen.drop("in_python"), "name", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    shell = F.col("file").rlike(SHELL) & ~is_("exports")
    reason = (
        F.when(is_("script"), "script").when(shell & ~is_("keeps") & ~is_("in_shell"), "shell").when(shell & is_("keeps") & ~is_("gains") & ~is_("anywhere"), "shell").when(is_("keeps") & is_("gains") & ~is_("anywhere"), "replaced")
    )
    return rows.select("name", "file", reason.alias("reason")).where("reason is not null")
