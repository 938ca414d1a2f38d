"""Functions, methods and classes that a framework calls by decorator, base class, annotation or form, so that no caller is seen.

Python's are read from its node table by joins of definitions with their decorators and base classes, to the line. Those of PHP and
Java are read from text by patterns and told by file and name alone; comments that hold code confuse them.

Dirty input. Null texts and files of other languages have no entries; files that don't parse have none of Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import syntax as T

# Decorators that register what stands below them, by their whole name.
WHOLE = ["receiver", "login_required", "permission_required", "csrf_exempt", "cache_page", "require_GET", "require_POST", "require_http_methods", "require_safe", "staff_member_required", "user_passes_test"]
# The same by what follows the last dot.
LAST = [
    "command", "callback", "group", "event", "get", "post", "put", "delete", "patch", "options", "head", "route", "websocket", "middleware", "on_event", "exception_handler", "before_request", "after_request",
    "errorhandler", "teardown_request", "teardown_appcontext", "context_processor", "shell_context_processor", "before_first_request", "task", "fixture", "parametrize", "usefixtures",
]
# Classes whose subclasses are called by method names.
URL_BASES = [
    "BaseHandler", "AbstractHTTPHandler", "AbstractBasicAuthHandler", "AbstractDigestAuthHandler", "HTTPHandler", "HTTPSHandler", "HTTPBasicAuthHandler", "ProxyBasicAuthHandler", "HTTPDigestAuthHandler",
    "ProxyDigestAuthHandler", "HTTPErrorProcessor", "FileHandler", "FTPHandler", "CacheFTPHandler", "DataHandler", "UnknownHandler", "HTTPDefaultErrorHandler", "HTTPRedirectHandler", "ProxyHandler", "HTTPCookieProcessor",
]
URL_METHODS = r"^http_error_|_(open|error|request|response)$"
WATCH_BASES = ["FileSystemEventHandler", "PatternMatchingEventHandler", "RegexMatchingEventHandler", "LoggingEventHandler"]
WATCH_METHODS = ["on_any_event", "on_moved", "on_created", "on_deleted", "on_modified", "on_closed", "on_closed_no_write", "on_opened"]
# Types that a model's relation returns, and methods of a contract.
RELATIONS = ["BelongsTo", "BelongsToMany", "HasMany", "HasOne", "HasManyThrough", "HasOneThrough", "MorphMany", "MorphOne", "MorphTo", "MorphToMany", "MorphedByMany"]
CONTRACT = r"\bimplements\b[^{]*\bCanResetPassword(Contract)?\b"
CONTRACT_METHODS = ["getEmailForPasswordReset", "sendPasswordResetNotification"]
# Annotations in lower case that a test runner reads; those with a capital all count.
ANNOTATIONS = r"@(?:[\w\\]*\\)?(?:[A-Z]\w*|dataProvider|depends|test|before|after|beforeClass|afterClass|covers|uses|group|ticket|preserveGlobalState|runInSeparateProcess)(?!\w|\\)"
MIGRATIONS = ["BaseJavaMigration", "JavaMigration", "org.flywaydb.core.api.migration.BaseJavaMigration", "org.flywaydb.core.api.migration.JavaMigration"]


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def python_entries(files: DataFrame) -> DataFrame:
    """(path, name, sl, reason) of Python files (path, lang, text): ``decorator`` or ``protocol``."""
    n = T.nodes(files.where("lang = 'python' and text is not null and (contains(text, '@') or contains(text, 'Handler') or contains(text, 'Processor'))"))
    kept = n.where("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef') or field in ('decorator_list', 'bases', 'func')").select("path", "id", "parent", "kind", "name", "field", "sl", "preview").checkpoint()
    defs = kept.where("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')").select("path", "id", "parent", "kind", "name", "sl")
    text = F.regexp_replace(F.trim(F.substring_index("preview", "(", 1)), r"\s+", "")
    marks = kept.where("field = 'decorator_list'").select("path", F.col("parent").alias("id"), text.alias("mark"))
    hit = F.col("mark").isin(WHOLE) | last_part(F.col("mark")).isin(LAST) | F.col("mark").startswith("pytest.mark.")
    decorated = defs.join(marks.where(hit), ["path", "id"], "left_semi").select("path", "name", "sl", F.lit("decorator").alias("reason"))
    bases = kept.where("field = 'bases' and kind in ('Name', 'Attribute')").select("path", "parent", last_part(text).alias("base"))
    methods = defs.where("kind <> 'ClassDef'").join(bases, ["path", "parent"])
    called = (F.col("name").rlike(URL_METHODS) & F.col("base").isin(URL_BASES)) | (F.col("name").isin(WATCH_METHODS) & F.col("base").isin(WATCH_BASES))
    return decorated.unionByName(methods.where(called).select("path", "name", "sl", F.lit("protocol").alias("reason"))).distinct()


def php_entries(files: DataFrame) -> DataFrame:
    """(path, name, reason) of PHP files: ``annotation``, ``relation``, ``contract`` or ``enum``."""
    php = files.where("lang = 'php' and text is not null")
    doc = php.select("path", F.explode(F.slice(F.split("text", r"/\*\*"), 2, 1 << 30)).alias("p"))
    below = F.regexp_extract(F.expr("substring(p, length(substring_index(p, '*/', 1)) + 3)"), r"^\s*(?:#\[[^\]]*\]\s*)*(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?(\w+)", 1)
    noted = doc.select("path", below.alias("name"), F.substring_index("p", "*/", 1).alias("doc")).where(F.col("doc").rlike(ANNOTATIONS)).select("path", "name", F.lit("annotation").alias("reason"))
    pieces = php.withColumn("contract", F.col("text").rlike(CONTRACT)).withColumn("ps", F.split("text", r"\bfunction\s+")).where("size(ps) > 1")
    each = pieces.select("path", "contract", F.explode(F.arrays_zip(F.expr("slice(ps, 1, size(ps) - 1)").alias("head"), F.expr("slice(ps, 2, size(ps) - 1)").alias("body"))).alias("z")).select("path", "contract", F.col("z.head").alias("head"), F.col("z.body").alias("body"))
    params = r"^&?(\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)"
    kind = F.substring_index(F.regexp_extract("body", params + r"\s*:\s*\??([\w\\]+)", 2), "\\", -1)
    each = each.select("path", "contract", "body", F.regexp_extract("body", r"^&?(\w+)", 1).alias("name"), F.regexp_extract("head", r"((?:\b(?:public|protected|private|static|final|abstract)\s+)*)$", 1).alias("mods"), kind.alias("type"))
    value = F.regexp_extract("body", params + r"\s*:\s*\??(?:self|static)\s*\{\s*return\s+new\s+(?:self|static)\s*\(\s*(?:'([^']*)'|\"([^\"]*)\")", 2)
    other = F.regexp_extract("body", params + r"\s*:\s*\??(?:self|static)\s*\{\s*return\s+new\s+(?:self|static)\s*\(\s*(?:'([^']*)'|\"([^\"]*)\")", 3)
    reason = (
        F.when(F.col("type").isin(RELATIONS) & ~F.col("mods").rlike("private|protected"), "relation").when(F.col("contract") & F.col("name").isin(CONTRACT_METHODS), "contract")
        .when(F.col("mods").contains("static") & F.col("type").isin("self", "static") & (F.concat(value, other) == F.col("name")), "enum")
    )
    return noted.unionByName(each.select("path", "name", reason.alias("reason"))).where("name <> '' and reason is not null").distinct()


def java_entries(files: DataFrame) -> DataFrame:
    """(path, name, reason) of Java classes that a migration runner finds by their direct parents: ``migration``."""
    heads = files.where("lang = 'java' and text is not null").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\bclass\s+\w+[^{;]*\{"), F.lit(0))).alias("head"))
    bare = F.regexp_replace(F.regexp_replace(F.col("head"), "<[^<>]*>", ""), "<[^<>]*>", "")
    parents = F.transform(F.split(F.regexp_extract(bare, r"\bclass\s+\w+\s*(?:extends|implements)\s+([^{]*)", 1), r"\s*,\s*|\s+implements\s+|\s+"), F.trim)
    return heads.where(F.arrays_overlap(parents, F.array(*map(F.lit, MIGRATIONS)))).select("path", F.regexp_extract("head", r"^class\s+(\w+)", 1).alias("name"), F.lit("migration").alias("reason")).distinct()


def entries(files: DataFrame) -> DataFrame:
    """(path, name, sl, reason) of files (path, lang, text); ``sl`` is null where the file and the name alone are known."""
    by_name = php_entries(files).unionByName(java_entries(files)).withColumn("sl", F.lit(None).cast("int"))
    return python_entries(files).unionByName(by_name.select("path", "name", "sl", "reason"))


def without_entries(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols (path, name, sl) that no framework calls."""
    e = found.select(F.col("path").alias("p"), F.col("name").alias("n"), F.col("sl").alias("l"))
    return symbols.join(e, (F.col("path") == F.col("p")) & (F.col("name") == F.col("n")) & (F.col("l").isNull() | (F.col("l") == F.col("sl"))), "left_anti")
