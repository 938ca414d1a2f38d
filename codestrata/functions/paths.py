"""Column expressions over paths and file heads: language, tests, generated files, exclusions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions and the language each one means.
EXTENSIONS = {
    "rust": ["rs"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"],
    "python": ["py", "pyi"],
    "javascript": ["js", "mjs", "cjs", "jsx"],
    "typescript": ["ts", "mts", "cts"],
    "tsx": ["tsx"],
    "go": ["go"],
    "php": ["php", "phtml"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "swift": ["swift"],
    "csharp": ["cs"],
    "bash": ["sh", "bash", "zsh"],
    "ruby": ["rb", "rake", "gemspec"],
    "zig": ["zig", "zon"],
    "xojo": ["xojo_code", "xojo_window", "xojo_menu", "xojo_toolbar", "xojo_report", "rbbas"],
}
# What an interpreter line must contain, first match wins.
SHEBANGS = [
    ("python", "python"),
    ("javascript", "node|deno|bun"),
    ("php", "php"),
    ("kotlin", "kotlin"),
    ("swift", "swift"),
    ("bash", "bash|/bin/sh|env sh|zsh"),
    ("ruby", "ruby"),
]
# Directory names that hold tests.
TEST_SEGMENTS = ["tests", "test", "Tests", "__tests__", "spec", "testdata", "androidTest", "sharedTest", "integrationTest"]
# Marks of generated files, in any case, for interface and liveness checks.
GENERATED_MARKS = [
    "automatically generated",
    "auto-generated",
    "autogenerated",
    "@generated",
    "generated by",
    "this file was generated",
    "code generated by",
    "file is generated",
]
# Marks of generated files, case kept, for scans.
SCAN_MARKS = ["@generated", "DO NOT EDIT", "Code generated by", "This file is auto-generated", "automatically generated"]
# Globs that co-change leaves out.
COCHANGE_EXCLUDES = [
    "vendor/**",
    "**/vendor/**",
    "node_modules/**",
    "**/node_modules/**",
    "dist/**",
    "**/dist/**",
    "build/**",
    "**/build/**",
    "target/**",
    "**/target/**",
    "**/composer.lock",
    "**/package-lock.json",
    "**/yarn.lock",
    "**/pnpm-lock.yaml",
    "**/Cargo.lock",
    "**/*.min.js",
    "**/*.min.css",
]
# A manifest and the lock file that goes with it.
LOCK_PAIRS = [
    ("Cargo.toml", "Cargo.lock"),
    ("package.json", "package-lock.json"),
    ("package.json", "pnpm-lock.yaml"),
    ("package.json", "yarn.lock"),
    ("pyproject.toml", "uv.lock"),
    ("pyproject.toml", "poetry.lock"),
    ("pyproject.toml", "pdm.lock"),
    ("Gemfile", "Gemfile.lock"),
    ("composer.json", "composer.lock"),
    ("go.mod", "go.sum"),
    ("mix.exs", "mix.lock"),
]
HEAD_BYTES = 4096


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def language(path: Column, first_line: Column | None = None) -> Column:
    """By extension, else by the interpreter line; null if neither tells."""
    ext = F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for lang, names in EXTENSIONS.items():
        out = F.when(ext.isin(names), lang).otherwise(out)
    if first_line is None:
        return out
    line, bang = F.lower(first_line), F.lit(None).cast("string")
    for lang, pattern in reversed(SHEBANGS):
        bang = F.when(line.rlike(pattern), lang).otherwise(bang)
    return F.coalesce(out, F.when(first_line.startswith("#!"), bang))


def header_language(path: Column, lang: Column, text: Column) -> Column:
    """C headers (.h) are C++ where their code, comments and strings apart, holds what C has no form for."""
    code = F.regexp_replace(text, r"""(?s)/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", " ")
    cpp = code.rlike(r"\bclass\s+\w+[^;{()=]*[{;]|\bnamespace\s+[\w:]*\s*[{=]|\btemplate\s*<|\btypename\s+\w|\b(public|private|protected)\s*:|\w\s*::\s*[\w~]|\bvirtual\s+\w|\bconstexpr\s+\w")
    return F.when((lang == "c") & F.lower(path).endswith(".h") & cpp, "cpp").otherwise(lang)


def is_test_file(path: Column) -> Column:
    """By the name alone. Suffixes such as FooTest.java keep their case, the others do not."""
    name = basename(path)
    low = F.lower(name)
    return (
        low.rlike(r"_test\.(go|py|rb|c|cpp|cc|sh)$|_spec\.rb$|\.bats$")
        | low.rlike(r"\.(test|spec)\.")
        | low.rlike(r"^test_.*\.py$|^conftest\.py$")
        | name.rlike(r"Tests?\.(java|kt|cs|php)$")
    )


def is_test_path(path: Column) -> Column:
    return is_test_file(path) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_SEGMENTS)))


def is_generated_name(path: Column) -> Column:
    name = basename(path)
    return name.rlike(r"^_ide_helper.*\.php$|^_lighthouse_ide_helper\.php$|\.min\.(js|css)$|\.bundle\.js$")


def has_mark(head: Column, marks: list[str], any_case: bool) -> Column:
    text = F.lower(head) if any_case else head
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return F.coalesce(found, F.lit(False))


def keep_candidate(path: Column, head: Column, exclude_generated: bool = True) -> Column:
    """Whether a scan takes a file: its language is known, by the interpreter line only where there is no
    extension, and neither its name nor its head says it is generated."""
    first = F.element_at(F.split(head, "\n"), 1)
    by_name = language(path).isNotNull()
    by_line = ~F.contains(basename(path), F.lit(".")) & language(path, first).isNotNull()
    keep = by_name | by_line
    return keep & ~is_generated_name(path) & ~has_mark(head, SCAN_MARKS, False) if exclude_generated else keep


def glob_regex(glob: str) -> str:
    """``**/`` is any directories, ``*`` and ``?`` stay within one; braces and classes as usual."""
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif c in "{},":
            out, i = out + {"{": "(?:", "}": ")", ",": "|"}[c], i + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out + "$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found


def last_rule(paths: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """(path, set): of ordered (glob, value) rules the last that matches decides; false if none does."""
    value = F.lit(False)
    for glob, on in rules:
        value = F.when(F.col("path").rlike(glob_regex(glob if "/" in glob else f"**/{glob}")), F.lit(on)).otherwise(value)
    return paths.select("path", value.alias("set"))


def lock_pairs(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(a, b) of manifests and lock files that lie in one directory."""
    known = F.broadcast(spark.createDataFrame(LOCK_PAIRS, "ma string, mb string"))
    p = paths.select("path", dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("name")).distinct()
    a = p.select(F.col("path").alias("a"), "dir", F.col("name").alias("ma")).join(known, "ma")
    return a.join(p.select(F.col("path").alias("b"), "dir", F.col("name").alias("mb")), ["dir", "mb"]).select("a", "b")


def is_import_line(line: Column) -> Column:
    """Whether a line imports or re-exports, in any of the languages."""
    t = F.trim(line)
    return F.coalesce(
        t.rlike(r"^import[ {]|^export[ {].* from[ \"']|= require\(|^require\(|^from .* import |^(pub )?use |^require(_relative)? |^#include |@import\(")
        | t.rlike(r"^export ?\{[^}]*\};?$")
        | (t.rlike(r"^using .*;$") & ~t.rlike(r"^using (var |\()")),
        F.lit(False),
    )


def statement_at(line: Column, column: Column) -> Column:
    """The part between semicolons around a column (0-based)."""
    before = F.element_at(F.split(F.substring(line, F.lit(1), column), ";"), -1)
    after = F.element_at(F.split(F.substring(line, column + 1, F.length(line)), ";"), 1)
    return F.concat(before, after)


def same_file(ref: Column, source: Column) -> Column:
    return (ref == source) | F.endswith(ref, F.concat(F.lit("/"), source))


def bare_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def has_token(line: Column, name: Column) -> Column:
    return F.array_contains(F.split(line, r"[^_\p{L}\p{N}]+"), name)
