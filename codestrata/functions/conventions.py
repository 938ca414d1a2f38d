"""What frameworks and test runners call by convention, and what liveness scans leave out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import TEST_SEGMENTS, basename, bare_name, matches_glob

# Directory names that liveness leaves out by default.
EXCLUDED_VENDOR = ["vendor", "node_modules", "bower_components", ".venv", "venv", ".tox"]
EXCLUDED_BUILD = ["target", "dist", "build", "out", "_build", "cmake-build-debug", "cmake-build-release"]
# Files whose code a web framework calls by its place.
LARAVEL_GLOBS = [
    "**/database/migrations/**",
    "**/database/migrations_*/**",
    "**/database/migrations-*/**",
    "**/database/seeds/**",
    "**/database/seeders/**",
    "**/database/factories/**",
    "**/database/views/**",
    "**/database/TableDefinitions/**",
    "**/app/Console/Commands/**",
    "**/app/Http/Controllers/**",
    "**/app/Http/Middleware/**",
    "**/app/Http/Requests/**",
    "**/app/Http/Resources/**",
    "**/app/GraphQL/**",
    "**/app/Listeners/**",
    "**/app/Providers/**",
    "**/app/Exceptions/**",
    "**/app/Casts/**",
    "**/app/Observers/**",
    "**/app/Policies/**",
    "**/app/Events/**",
    "**/app/Jobs/**",
    "**/app/Notifications/**",
    "**/app/Mail/**",
    "**/app/Rules/**",
    "**/app/Broadcasting/**",
    "**/_ide_helper.php",
    "**/_ide_helper_models.php",
    "**/.phpstorm.meta.php",
]
NEXTJS_GLOBS = [
    "**/app/**/page.{js,jsx,ts,tsx}",
    "**/app/**/layout.{js,jsx,ts,tsx}",
    "**/app/**/loading.{js,jsx,ts,tsx}",
    "**/app/**/error.{js,jsx,ts,tsx}",
    "**/app/**/not-found.{js,jsx,ts,tsx}",
    "**/app/**/template.{js,jsx,ts,tsx}",
    "**/app/**/default.{js,jsx,ts,tsx}",
    "**/app/**/global-error.{js,jsx,ts,tsx}",
    "**/app/**/route.{js,jsx,ts,tsx}",
    "**/pages/**/*.{js,jsx,ts,tsx}",
    "**/middleware.{js,ts}",
    "**/instrumentation.{js,ts}",
]
PRESETS = {"laravel": LARAVEL_GLOBS, "nextjs": NEXTJS_GLOBS}
# Methods that a unit-test runner calls on its classes.
UNITTEST_METHODS = ["setUp", "tearDown", "setUpClass", "tearDownClass", "asyncSetUp", "asyncTearDown", "addCleanup", "addClassCleanup", "addAsyncCleanup"]
PHPUNIT_METHODS = ["setUp", "tearDown", "setUpBeforeClass", "tearDownAfterClass"]
MOST_XML_BYTES = 1 << 20


def excluded_segments(include_vendor: bool = False, include_tests: bool = False, include_build: bool = False) -> list[str]:
    return [*([] if include_vendor else EXCLUDED_VENDOR), *([] if include_tests else TEST_SEGMENTS), *([] if include_build else EXCLUDED_BUILD)]


def framework(manifest: Column) -> Column:
    """The preset that a package manifest (JSON text) calls for, null for none."""
    has = lambda part: F.array_contains(F.json_object_keys(F.get_json_object(manifest, f"$.{part}")), "next")
    return F.when(F.coalesce(has("dependencies"), F.lit(False)) | F.coalesce(has("devDependencies"), F.lit(False)), "nextjs")


def by_framework(path: Column, preset: str) -> Column:
    return matches_glob(path, PRESETS[preset])


def is_phpunit(name: Column, kind: Column, lang: Column) -> Column:
    """Test classes by their ending; the runner's own methods and test methods."""
    short = bare_name(name)
    method = short.isin(*PHPUNIT_METHODS) | short.rlike("^test[A-Z_]")
    return (lang == "php") & ((kind == "class") & short.rlike("Test(Case)?$") | kind.isin("method", "function") & method)


def is_python_test(name: Column, kind: Column, lang: Column, path: Column, container: Column, in_unittest: Column) -> Column:
    """``in_unittest``: for a class, whether it descends from a unit-test base in its file; else whether its
    container does. Functions of a conftest, test functions of a test module, and a test class's methods."""
    short, file = bare_name(name), basename(path)
    owner = F.coalesce(container, F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1)))
    module = file.rlike(r"^test_.*\.py$|^.+_test\.py$") & (file != "conftest.py")
    top = owner.isNull() & ((file == "conftest.py") | module & short.startswith("test_"))
    inside = F.coalesce(in_unittest, F.lit(False))
    member = owner.isNotNull() & inside & (short.startswith("test_") | short.isin(*UNITTEST_METHODS))
    return (lang == "python") & F.when(kind == "class", inside).otherwise(kind.isin("function", "method") & (top | member))


def xml_references(files: DataFrame) -> DataFrame:
    """(path, name): what Android XML (path, text) names: values of five attributes and tags with a dot. A value
    counts whole where it is an identifier, and by what follows its last dot; # and $ part nested classes."""
    attr = F.regexp_extract_all("text", F.lit(r"""(?<![\w:.-])(?:android:name|tools:context|android:onClick|app:layout_behavior|class)[ \t]*=[ \t]*(?:"([^"]*)"|'([^']*)')"""), F.lit(0))
    value = F.transform(attr, lambda a: F.regexp_replace(F.regexp_replace(a, r"""^[^"']*["']""", ""), r"""["']$""", ""))
    tags = F.filter(F.regexp_extract_all("text", F.lit(r"<([A-Za-z_][\w.]*)"), F.lit(1)), lambda t: F.contains(F.rtrim(t, F.lit(".")), F.lit(".")))
    parts = F.flatten(F.transform(F.concat(value, F.transform(tags, lambda t: F.rtrim(t, F.lit(".")))), lambda v: F.split(v, "[#$]")))
    clean = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^\.+", ""))
    both = F.concat(clean, F.transform(clean, lambda p: F.substring_index(p, ".", -1)))
    rows = files.where(F.octet_length("text") <= MOST_XML_BYTES).select("path", F.explode(F.array_distinct(both)).alias("name"))
    return rows.where(F.col("name").rlike(r"^[A-Za-z_]\w*$")).distinct()


def untracked(files: DataFrame, tracked: DataFrame, most_bytes: int = 256 << 10, most_lines: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Files (path, text) that version control does not know: (taken as all-added, left out with a reason)."""
    new = files.join(tracked.select("path"), "path", "left_anti").where(~F.col("path").rlike("[\r\n]"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    large = (F.octet_length("text") > most_bytes) | (lines > most_lines)
    return new.where(~large), new.where(large).select("path", F.lit("untracked_file_too_large").alias("reason"))


def subcommand(commands: DataFrame, program: str, known: list[str], column: str = "command", out: str = "subcommand") -> DataFrame:
    """Adds the subcommand with which a shell line runs ``program``, null for none.

    Quotes are minded when the line is cut at ; | and &&; settings, env, command and time before the program
    are passed over, flags after it too. Without the program in it a line never reaches Python.
    """
    takes_value = {"--config", "-o"}

    def segments(line: str) -> list[str]:
        out_, begin, i, quote = [], 0, 0, ""
        while i < len(line):
            c = line[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c in ";|" or line.startswith("&&", i):
                out_.append(line[begin:i])
                i += 1 if line[i : i + 2] in ("||", "&&") else 0
                begin = i + 1
            i += 1
        return [*out_, line[begin:]]

    def flags(words: list[str]) -> list[str]:
        while words and words[0][:1] == "-" and len(words[0]) > 1:
            words = words[2 if words[0] in takes_value else 1 :]
        return words

    def find(line: str) -> str | None:
        for segment in segments(line):
            words = segment.split()
            while words:
                name = words[0].rsplit("/", 1)[-1]
                if "=" in words[0][1:] or name in ("env", "command"):
                    words = words[1:]
                elif name == "time":
                    words = flags(words[1:])
                elif name == program:
                    rest = flags(words[1:])
                    return rest[0] if rest and rest[0] in known else None
                else:
                    break
        return None

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: find(x) if x else None)

    return commands.withColumn(out, F.when(F.contains(F.col(column), F.lit(program)), run(F.col(column))))
