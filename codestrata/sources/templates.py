"""Names that component templates use: interpolations, bindings, control-flow blocks and element selectors.

Java regular expressions find the places; what stands in them is cut into identifiers, of which those that begin an
expression count, not the members behind a dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of template expressions that name nothing.
WORDS = ["true", "false", "null", "undefined", "this", "let", "of", "as", "if", "else", "for", "track", "async", "typeof", "in", "index", "first", "last", "even", "odd", "count"]
PLACES = r"""\{\{([\s\S]*?)\}\}|(?:\[[\w.()-]+\]|\([\w.-]+\)|\*\w+)\s*=\s*"([^"]*)"|@(?:if|for|switch|case|let)\s*\(?([^{;]*)"""


def expressions(text: Column) -> Column:
    """The expressions of a template, strings and pipes' names blanked."""
    found = F.regexp_extract_all(text, F.lit(PLACES), F.lit(0))
    bare = F.transform(found, lambda e: F.regexp_replace(F.regexp_replace(e, r"""^(?:\[[\w.()-]+\]|\([\w.-]+\)|\*\w+)\s*=|^@\w+""", " "), r"""'[^']*'|`[^`]*`""", " "))
    return F.transform(bare, lambda e: F.regexp_replace(F.regexp_replace(e, r"(?<!\|)\|(?!\|)\s*[A-Za-z_]\w*", " "), r"\.\s*[A-Za-z_$][\w$]*", " "))


def names(text: Column) -> Column:
    each = F.flatten(F.transform(expressions(text), lambda e: F.regexp_extract_all(e, F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1))))
    return F.array_sort(F.array_except(F.array_distinct(each), F.array(*map(F.lit, WORDS))))


def template_names(files: DataFrame) -> DataFrame:
    """(path, name) of template (path, text) files."""
    return files.select("path", F.explode(names(F.col("text"))).alias("name"))


def components(files: DataFrame) -> DataFrame:
    """(path, class, selector, template, linked): components of (path, text) sources; ``linked`` is the path of their
    template file, ``template`` the text of one written inline."""
    t = F.col("text")
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    url = part(r"""templateUrl\s*:\s*['"`]([^'"`]+)['"`]""")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    from ..operators.lexing import resolved

    return files.where(t.rlike(r"@Component\s*\(")).select(
        "path", part(r"class\s+([A-Za-z_$][\w$]*)").alias("class"), part(r"""selector\s*:\s*['"`]([^'"`]+)['"`]""").alias("selector"),
        part(r"template\s*:\s*`([^`]*)`").alias("template"), F.when(url.isNotNull(), resolved(F.concat(folder, url))).alias("linked"),
    )


def component_uses(files: DataFrame, components_: DataFrame) -> DataFrame:
    """(path, class): components whose selector stands as an element in a template (path, text)."""
    tags = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"<([a-z][\w-]*)"), F.lit(1)))).alias("selector"))
    return tags.join(components_.select("class", "selector"), "selector").select("path", "class").distinct()


def positioned(files: DataFrame, components_: DataFrame) -> DataFrame:
    """(path, component, ln, line_text, name): lines, from 0, of linked templates that name something, with the component
    (path) that links them. Expressions over several lines are told by the whole text."""
    linked = components_.where("linked is not null").select(F.col("linked").alias("path"), F.col("path").alias("component")).distinct()
    own = files.join(linked, "path")
    named = own.select("path", "component", F.explode(names(F.col("text"))).alias("name"))
    lines = own.select("path", "component", F.posexplode(F.split("text", "\n")).alias("ln", "line_text"))
    words = lines.select("path", "component", "ln", "line_text", F.explode(F.array_distinct(F.regexp_extract_all("line_text", F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1)))).alias("name"))
    return words.join(named, ["path", "component", "name"]).select("path", "component", "ln", "line_text", "name")


def asset_names(xml: DataFrame, templates: DataFrame) -> DataFrame:
    """(key): names that assets of either kind (path, name) use."""
    return xml.select(F.col("name").alias("key")).unionByName(templates.select(F.col("name").alias("key"))).distinct()
