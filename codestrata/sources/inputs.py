"""Where a run's inputs come from: path lists, files, changed files, diffs, rule files, manifests, usage logs."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from . import diffs, git

MOST_BYTES = 100 << 20
# What a rule says.
RULE_FIELDS = "id string, language string, severity string, message string, pattern string, query string"
DEPENDENCIES = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def path_list(spark: SparkSession, path: str | None = None, many: str | None = None, file: str | None = None) -> DataFrame:
    """(ord, path) of one path, a comma list or a file with a path a line; exactly one of the three, and not empty."""
    if sum(x is not None for x in (path, many, file)) != 1:
        raise ValueError("give one of a path, a list or a file")
    if file is not None:
        rows = spark.read.text(file).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("path")).where("path <> ''")
        if not rows.limit(1).count():
            raise ValueError("no path")
        return rows
    parts = [p for p in (x.strip() for x in (many.split(",") if many is not None else [path])) if p]
    if not parts:
        raise ValueError("no path")
    return spark.createDataFrame([*enumerate(parts)], "ord long, path string")


def bounded_text(files: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of (path, content) files: (path, text) that are small enough and UTF-8, and (path, reason) of the others."""
    reason = F.when(F.octet_length("content") > most_bytes, "too_large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
    rows = files.withColumn("reason", reason)
    return rows.where("reason is null").select("path", F.col("content").cast("string").alias("text")), rows.where("reason is not null").select("path", "reason")


def read_file(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, text, lang) of one file; its size is known from the listing, so a large one is never read."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes).select("path", "content")
    text, _ = bounded_text(rows, most_bytes)
    return text.withColumn("lang", P.language(F.col("path"), F.element_at(F.split(F.substring("text", 1, P.HEAD_BYTES), "\n"), 1)))


def changed_files(sources: list[DataFrame], exclude: list[str] | None = None) -> DataFrame:
    """(path): the union of (path) lists, each once, sorted, without the globs that co-change leaves out."""
    if not sources:
        raise ValueError("no source")
    rows = sources[0].select("path")
    for s in sources[1:]:
        rows = rows.unionByName(s.select("path"))
    return rows.distinct().where(~P.matches_glob(F.col("path"), P.COCHANGE_EXCLUDES if exclude is None else exclude)).orderBy("path")


def diff_source(spark: SparkSession, inline: str | None = None, file: str | None = None, root: str | None = None, base: str = "HEAD", stdin: bool = False) -> tuple[DataFrame, str | None]:
    """((diff_id, text), why it was skipped): the first that is given of a text, a file, a working copy and the standard
    input. A folder that is no working copy is skipped with an empty table, not an error."""
    empty = spark.createDataFrame([], "diff_id string, text string")
    if inline is not None:
        return spark.createDataFrame([("inline", inline)], "diff_id string, text string"), None
    if file is not None:
        return spark.read.text(file, wholetext=True).select(F.lit(file).alias("diff_id"), F.col("value").alias("text")), None
    if root is not None:
        if not git.is_working_copy(root):
            return empty, "not_a_git_repository"
        return git.diff(spark, root, base), None
    if stdin:
        return spark.createDataFrame([("stdin", sys.stdin.read())], "diff_id string, text string"), None
    raise ValueError("no diff")


def old_ranges(lines: DataFrame) -> DataFrame:
    """(diff_id, path, lo, hi): lines that hunks replace on the old side, from 1; hunks that only add have none."""
    h = lines.where("hunk is not null and old_count > 0").select("diff_id", F.col("old_path").alias("path"), "hunk", "old_start", "old_count").distinct()
    return h.select("diff_id", "path", F.col("old_start").alias("lo"), (F.col("old_start") + F.col("old_count") - 1).alias("hi"))


def blamed(ranges: DataFrame, blame: DataFrame) -> DataFrame:
    """(path, sha): commits that last touched the old lines (path, lo, hi), by (path, ln, sha), ln from 0."""
    r = ranges.select(F.col("path").alias("rp"), "lo", "hi")
    return blame.join(r, (F.col("path") == F.col("rp")) & (F.col("ln") + 1 >= F.col("lo")) & (F.col("ln") + 1 <= F.col("hi"))).select("path", "sha").distinct()


def within_workspace(commit_files: DataFrame, prefix: str) -> DataFrame:
    """(sha, path, total): files below a folder, relative to it; ``total`` counts all files of the commit."""
    p = prefix.strip("/") + "/" if prefix.strip("/") else ""
    total = commit_files.groupBy("sha").agg(F.countDistinct("path").alias("total"))
    rows = commit_files.where(F.col("path").startswith(p)).select("sha", F.substring("path", len(p) + 1, 1 << 20).alias("path"))
    return rows.join(total, "sha")


def attribute_rules(files: DataFrame) -> DataFrame:
    """(dir, ord, glob, value): generated marks of attribute files (path, text), in order; a line without such a mark
    says nothing."""
    lines = files.select(P.dirname(F.col("path")).alias("dir"), F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    words = F.split(F.trim("line"), r"\s+")
    mark = F.try_element_at(F.filter(words, lambda w: w.rlike(r"^[-!]?linguist-generated(=.*)?$")), F.lit(-1))
    on = ~mark.rlike(r"^[-!]|=(false|unset)$")
    return lines.withColumn("mark", mark).where(F.col("mark").isNotNull() & ~F.trim("line").startswith("#")).select("dir", "ord", F.element_at(words, 1).alias("glob"), on.alias("value"))


def generated_by_attributes(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, generated): of the rules in its folder and those above the last one that matches decides, deeper folders
    last. Rules are joined by the folder, so a path meets only its own."""
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    own = paths.select("path", F.explode(up).alias("dir")).join(rules, "dir")
    rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("dir") + 2, F.length("path")))
    target = F.when(F.contains(F.rtrim(F.col("glob"), F.lit("/")), F.lit("/")), rel).otherwise(P.basename(F.col("path")))
    escaped = F.regexp_replace(F.ltrim(F.col("glob"), F.lit("/")), r"([.+^$(){}|\\])", r"\\$1")
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"\*\*/?", "\u0001"), r"\*", "[^/]*"), r"\?", "[^/]")
    hit = own.where(F.regexp_like(target, F.concat(F.lit("^"), F.replace(pattern, F.lit("\u0001"), F.lit(".*")), F.lit("$"))))
    last = hit.groupBy("path").agg(F.max_by("value", F.struct(F.length("dir"), F.col("ord"))).alias("value"))
    return paths.select("path").join(last, "path", "left").select("path", F.coalesce("value", F.lit(False)).alias("generated"))


def yaml_rules(text: str) -> list[dict[str, str]]:
    """Rules of the plain YAML that rule files are written in: a list of flat mappings, values plain, quoted or blocks."""
    rules, key, indent = [], None, 0
    for raw in text.splitlines():
        if not raw.strip() or raw.lstrip().startswith("#") and key is None:
            continue
        if key is not None and len(raw) - len(raw.lstrip()) > indent:
            rules[-1][key] += ("\n" if rules[-1][key] else "") + raw.strip()
            continue
        key = None
        m = re.match(r"^(\s*)(-\s+)?([A-Za-z_]+):\s*(.*)$", raw)
        if not m or not (m[2] or rules):
            raise ValueError(f"not a rule line: {raw!r}")
        if m[2]:
            rules.append({})
        value = m[4].strip()
        if value in ("|", "|-", ">", ">-"):
            key, indent, value = m[3], len(m[1]) + len(m[2] or ""), ""
        elif value[:1] in "'\"" and value[:1] == value[-1:] and len(value) > 1:
            value = value[1:-1].replace("''", "'") if value[0] == "'" else value[1:-1].encode().decode("unicode_escape")
        else:
            value = re.sub(r"\s+#.*$", "", value)
        rules[-1][m[3]] = value
    return rules


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, language, severity, message, pattern, query) of one rule file, or of all in a folder, files by path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.y*ml").select(F.col("_metadata.file_path").alias("path"), "value").orderBy("path").collect()  # rule files, not data
    names = [c.split()[0] for c in RULE_FIELDS.split(", ")]
    found = [tuple(r.get(n) for n in names) for f in files for r in yaml_rules(f["value"])]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "ord int, " + RULE_FIELDS)


def rule_warnings(rules_: DataFrame) -> DataFrame:
    """(id, warning) of rules that have both or neither of a query and a pattern."""
    w = F.when(F.col("query").isNotNull() & F.col("pattern").isNotNull(), "both").when(F.col("query").isNull() & F.col("pattern").isNull(), "neither")
    return rules_.select("id", w.alias("warning")).where("warning is not null")


def packages(files: DataFrame) -> DataFrame:
    """(path, package): what manifests (path, text) depend on; text that is no JSON names nothing."""
    keys = F.flatten(F.array(*[F.coalesce(F.json_object_keys(F.get_json_object("text", f"$.{d}")), F.array().cast("array<string>")) for d in DEPENDENCIES]))
    return files.where(P.basename(F.col("path")) == "package.json").where(F.try_parse_json("text").isNotNull()).select("path", F.explode(F.array_distinct(keys)).alias("package"))


def usage_log(spark: SparkSession, path: str, source: str, project: Column | None = None, modified_after: str | None = None) -> DataFrame:
    """Lines of newline-delimited logs below a folder: (source, project, session, ord, kind, tool, command, prompt, day).

    Two dialects are read by their shape: messages of ``type`` user and assistant whose content lists ``tool_use`` blocks,
    and items ``response_item`` whose payload is a ``function_call`` or a user message. Lines that are no JSON objects are
    left out. The day is that of a file's first time stamp; files older than ``modified_after`` aren't listed."""
    options = {"recursiveFileLookup": True} | ({"modifiedAfter": modified_after} if modified_after else {})
    raw = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("session"), F.monotonically_increasing_id().alias("ord"), "value")
    return log_rows(raw, source, project)


def log_rows(raw: DataFrame, source: str, project: Column | None = None) -> DataFrame:
    """As ``usage_log``, of (session, ord, value) lines."""
    v = F.try_parse_json("value")
    rows = raw.withColumn("v", v).where(F.col("v").isNotNull() & F.ltrim("value").startswith("{"))
    get = lambda p, t="string": F.try_variant_get(F.col("v"), p, t)
    kind = F.when(get("$.type") == "user", "user").when(get("$.payload.role") == "user", "user").when(get("$.type").isin("assistant", "response_item"), "assistant")
    block = "array<struct<type string, name string, text string, input struct<command string>>>"
    content = F.coalesce(get("$.message.content", block), F.from_json(get("$.message.content"), block), get("$.payload.content", block))
    call = F.when(get("$.payload.type") == "function_call", F.array(F.struct(get("$.payload.name").alias("tool"), F.get_json_object(get("$.payload.arguments"), "$.command").alias("command"))))
    used = F.transform(F.filter(content, lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()), lambda b: F.struct(b["name"].alias("tool"), b["input"]["command"].alias("command")))
    said = F.array_join(F.transform(F.filter(content, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    prompt = F.when(F.col("kind") == "user", F.coalesce(F.when(content.isNull(), get("$.message.content")), said))
    rows = rows.withColumn("kind", kind).withColumn("stamp", F.substring(get("$.timestamp"), 1, 10)).withColumn("prompt", prompt)
    rows = rows.withColumn("calls", F.when(F.col("kind") == "assistant", F.coalesce(call, used)))
    days = rows.where("length(stamp) = 10").groupBy("session").agg(F.min_by("stamp", "ord").alias("day"))
    rows = rows.where("kind is not null").select("session", "ord", "kind", "prompt", F.explode_outer("calls").alias("call"))
    out = rows.join(days, "session", "left").withColumn("source", F.lit(source)).withColumn("project", project if project is not None else F.regexp_extract("session", r"([^/]+)/[^/]+$", 1))
    return out.select("source", "project", "session", "ord", "kind", F.col("call.tool").alias("tool"), F.col("call.command").alias("command"), "prompt", "day")


def log_totals(log: DataFrame) -> DataFrame:
    """(source, files, sessions, calls, records) of a log."""
    return log.groupBy("source").agg(F.countDistinct("session").alias("files"), F.countDistinct(F.when(F.col("kind") == "user", F.col("session"))).alias("sessions"), F.count("tool").alias("calls"), F.count(F.lit(1)).alias("records"))


def for_liveness(changed: DataFrame, excluded: list[str], glob: str | None = None) -> DataFrame:
    """Changed (path)s that a liveness check looks at: no way out of the root, no excluded folder, a known language, in
    the glob."""
    safe = ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = changed.where(safe & P.language(F.col("path")).isNotNull())
    if excluded:
        rows = rows.where(~F.arrays_overlap(folders, F.array(*map(F.lit, excluded))))
    return rows.where(P.matches_glob(F.col("path"), [glob])) if glob else rows


def for_interface(changed: DataFrame, heads: DataFrame, generated: DataFrame) -> DataFrame:
    """Changed (path)s whose interface counts: inside the root, no tests, generated neither by an attribute file nor by a
    mark in their first bytes (path, head)."""
    inside = ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")
    rows = changed.where(inside & ~P.is_test_path(F.col("path")) & ~P.is_generated_name(F.col("path")))
    marked = heads.where(P.has_mark(F.substring("head", 1, P.HEAD_BYTES), P.GENERATED_MARKS, True)).select("path")
    return rows.join(generated.where("generated").select("path"), "path", "left_anti").join(marked, "path", "left_anti")


def only_folded(files: DataFrame) -> bool:
    """Whether all (lang) of a change compare names in any case, so that nothing can be said about references."""
    from ..operators.lexing import ANY_CASE

    row = files.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("lang").isin(*ANY_CASE)).alias("folded")).first()
    return bool(row["n"]) and bool(row["folded"])


def checked_sources(sources: DataFrame, most: int = 500) -> DataFrame:
    """The (path) list, refused above ``most``: the answer would say nothing and the join would grow with it."""
    n = sources.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} changed files")
    return sources


def without_context(text: DataFrame) -> DataFrame:
    """Body lines of (diff_id, text) diffs, without those that did not change."""
    return diffs.parse(text).where("tag is null or tag <> ' '")
