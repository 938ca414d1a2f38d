"""Ignore files: which paths of a tree a scan passes over.

Rules are rows, read from the ignore files of all folders; a path meets those of its own folders by an equi-join. A folder that is ignored hides
all that lies below it, and nothing there can be taken back. So every prefix of a path, the path itself included, is judged by
itself: by the last rule that matches it, deeper folders after higher ones, ``.ignore`` files after ``.gitignore``; a path is
ignored if one of its prefixes is.

Rules: blank lines and those that begin with # say nothing; ! takes back; a slash at the end means folders alone, one elsewhere binds the rule to
its folder, without one it holds for names at any depth; * and ? stop at slashes, ** spans them; [..] are
classes, a backslash takes the next character as it is. A rule with an open class matches nothing.

Dirty input. Null paths have no verdict and are left out, null texts hold no rules, repeated paths are answered once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# Names of ignore files, weakest first.
IGNORE_FILES = [".gitignore", ".ignore"]


def glob_pattern(glob: str) -> str | None:
    """A Java regular expression for a rule without its marks; None for one that matches nothing."""
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == n or glob[i + 2] == "/"):
            if i + 2 == n:
                return out + ".+" if i else ".*"
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += "[^/]*"
            while i + 1 < n and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + (3 if glob[i + 1 : i + 2] in ("!", "^") else 2))
            if end < 0:
                return None
            inner = glob[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            body = "".join("\\" + x if x in "\\[]&^" else x for x in inner[negated:])
            out, i = out + f"(?!/)[{'^' if negated else ''}{body}]", end
        else:
            if c == "\\" and i + 1 < n:
                i, c = i + 1, glob[i + 1]
            out += c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c
        i += 1
    return out


def _patterns(glob: pd.Series) -> pd.Series:
    return glob.map(glob_pattern)


def ignore_rules(files: DataFrame) -> DataFrame:
    """(dir, strength, ord, pattern, takes_back, folders, bound): the rules of the ignore files among (path, text) files."""
    own = files.where(P.basename(F.col("path")).isin(*IGNORE_FILES) & F.col("text").isNotNull())
    strength = F.array_position(F.array(*map(F.lit, IGNORE_FILES)), P.basename(F.col("path"))).cast("int")
    rows = own.select(P.dirname(F.col("path")).alias("dir"), strength.alias("strength"), F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("takes_back", F.col("line").startswith("!")).withColumn("line", F.regexp_replace("line", "^!", ""))
    rows = rows.withColumn("folders", F.col("line").endswith("/")).withColumn("line", F.regexp_replace("line", "/$", ""))
    rows = rows.withColumn("bound", F.contains("line", F.lit("/"))).withColumn("pattern", F.pandas_udf(_patterns, "string")(F.regexp_replace("line", "^/", "")))
    return rows.where("pattern is not null and line <> ''").select("dir", "strength", "ord", "pattern", "takes_back", "folders", "bound")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of (path)s under the ``rules`` of ``ignore_rules``."""
    once = paths.select("path").where("path is not null").distinct()
    parts = F.split("path", "/")
    prefixes = once.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("prefix"), (n < F.size(parts)).alias("folder")))).alias("k", "p"))
    prefixes = prefixes.select("path", "p.prefix", "p.folder")
    # Prefixes are shared: each is judged once.
    judged = prefixes.select("prefix", "folder").distinct()
    cut = F.split("prefix", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(cut) - 1), lambda n: F.array_join(F.slice(cut, 1, n), "/"))
    met = judged.select("prefix", "folder", F.explode(above).alias("dir")).join(rules, "dir").where(~F.col("folders") | F.col("folder"))
    rel = F.when(F.col("dir") == "", F.col("prefix")).otherwise(F.substring(F.col("prefix"), F.length("dir") + 2, F.length("prefix")))
    target = F.when(F.col("bound"), rel).otherwise(F.substring_index("prefix", "/", -1))
    hit = met.where(F.regexp_like(target, F.concat(F.lit("(?s)^(?:"), F.col("pattern"), F.lit(")$"))))
    last = hit.groupBy("prefix", "folder").agg(F.max_by("takes_back", F.struct("strength", F.length("dir"), "ord")).alias("takes_back"))
    hidden = prefixes.join(last.where("not takes_back"), ["prefix", "folder"], "left_semi").select("path").distinct()
    return once.join(hidden.withColumn("ignored", F.lit(True)), "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (path, ...) that no rule hides."""
    return files.join(ignored(files, rules).where("ignored").select("path"), "path", "left_anti")
