"""Unified diffs as rows.

Whether a line is a header or the body of a hunk depends on how many lines the hunk still has, so a diff is
walked from its first line to its last; diffs are walked in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.limits import frames

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
SCHEMA = "diff_id string, old_path string, new_path string, hunk int, old_start int, old_count int, new_start int, new_count int, ord int, tag string, text string, new_ln int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def unquoted(path: str) -> str:
    """A header's path: without the quotes, their escapes and the a/ or b/ before it."""
    if path[:1] == '"' and path[-1:] == '"':
        path = path[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
    path = path.split("\t")[0]
    return path[2:] if path[:2] in ("a/", "b/") else path


def rows(diff_id: str, text: str) -> Iterator[tuple]:
    """A row a body line: tag +, - or a space; new_ln is its 1-based line on the new side (for a removal, the
    line that follows it). A file without hunks has one row without a tag."""
    old = new = None
    hunk, ord_, head, ln, left, seen = 0, 0, (0, 0, 0, 0), 0, [0, 0], True
    for line in text.split("\n"):  # form feeds and other separators are no ends of lines
        line = line[:-1] if line.endswith("\r") else line
        if left[0] or left[1]:
            tag = line[:1]
            if tag == "\\":
                continue
            if tag not in "+-" or not tag:
                tag = " "
            ord_ += 1
            yield diff_id, old, new, hunk, *head, ord_, tag, line[1:], ln
            if tag != "-":
                ln, left[1] = ln + 1, max(0, left[1] - 1)
            if tag != "+":
                left[0] = max(0, left[0] - 1)
        elif line.startswith("--- "):
            if not seen:
                yield diff_id, old, new, None, None, None, None, None, None, None, None, None
            old, new, hunk, seen = unquoted(line[4:]), None, 0, False
        elif line.startswith("+++ "):
            new = unquoted(line[4:])
        elif (m := HUNK.match(line)) and new is not None:
            head = (int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1))
            hunk, ord_, ln, left, seen = hunk + 1, 0, head[2], [head[1], head[3]], True
    if not seen:
        yield diff_id, old, new, None, None, None, None, None, None, None, None, None


def parse(diffs: DataFrame) -> DataFrame:
    """Body lines of (diff_id, text) diffs. Null texts have none."""

    def run(batches):
        for b in batches:
            found = (r for i, t in zip(b["diff_id"], b["text"], strict=True) if t is not None for r in rows(i, t))
            for out in frames(found, COLUMNS):
                yield out.astype({c: "Int32" for c in ("hunk", "old_start", "old_count", "new_start", "new_count", "ord", "new_ln")})

    return diffs.select("diff_id", "text").mapInPandas(run, SCHEMA)


def hunks(lines: DataFrame) -> DataFrame:
    """(diff_id, path, hunk, old_start, old_count, new_start, new_count, added_in_hunk)."""
    return (
        lines.where("hunk is not null").groupBy("diff_id", F.col("new_path").alias("path"), "hunk", "old_start", "old_count", "new_start", "new_count")
        .agg(F.count(F.when(F.col("tag") == "+", 1)).cast("int").alias("added_in_hunk"))
    )


def added_lines(lines: DataFrame) -> DataFrame:
    """(diff_id, path, line): added lines, 0-based."""
    return lines.where("tag = '+'").select("diff_id", F.col("new_path").alias("path"), (F.col("new_ln") - 1).alias("line"))


def deleted_at(lines: DataFrame) -> DataFrame:
    """(diff_id, path, line): where on the new side something was removed, 0-based."""
    return lines.where("tag = '-'").select("diff_id", F.col("new_path").alias("path"), F.greatest(F.col("new_ln") - 1, F.lit(0)).alias("line"))


def changed_paths(lines: DataFrame) -> DataFrame:
    """Old and new paths without the null device, each once."""
    both = lines.select("diff_id", F.explode(F.array("old_path", "new_path")).alias("path"))
    return both.where("path is not null and path <> '/dev/null'").distinct()


def signature_changes(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(diff_id, path, name, old_line, new_line): per name the first removed and the first added line of a file
    that hold it as a word and look like a declaration, where they differ. A short list of names is broadcast: a common name's lines
    would all be shuffled to one task."""
    from ..functions.paths import has_token
    from ..operators.lexing import sized

    looks = F.col("text").rlike(r"\(|\b(fn|def|func|function|class|struct|interface|sub|fun)\b")
    body = lines.where(F.col("tag").isin("+", "-") & looks)
    # Words are joined to the names by equality; what is only part of a word is told apart afterwards.
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))
    spelled = F.array_union(words, F.flatten(F.transform(words, lambda w: F.split(w, r"\$"))))
    hit = body.withColumn("name", F.explode(spelled)).join(sized(names.select("name").distinct()), "name", "left_semi").where(has_token(F.col("text"), F.col("name")))
    at = F.struct("hunk", "ord")
    first = lambda tag: F.min_by(F.trim("text"), F.when(F.col("tag") == tag, at))
    return hit.groupBy("diff_id", F.col("new_path").alias("path"), "name").agg(first("-").alias("old_line"), first("+").alias("new_line")).where("old_line <> new_line")


def all_added(files: DataFrame) -> DataFrame:
    """Unified diffs (diff_id, text) in which each file (path, text) is new, every line added; what version control does not know
    yet takes part in a review this way (``conventions.untracked``). Empty files have no hunk. Null texts are left out."""
    ended = F.col("text").endswith("\n")
    body = F.when(ended, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    n = F.size(F.split(body, "\n")).cast("string")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\nnew file mode 100644\n"))
    hunk = F.concat(F.lit("--- /dev/null\n+++ b/"), F.col("path"), F.lit("\n@@ -0,0 +1,"), n, F.lit(" @@\n+"), F.replace(body, F.lit("\n"), F.lit("\n+")), F.when(ended, "\n").otherwise("\n\\ No newline at end of file\n"))
    return files.where("path is not null and text is not null").select(F.col("path").alias("diff_id"), F.when(F.col("text") == "", head).otherwise(F.concat(head, hunk)).alias("text"))
