"""Output sizes and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = r"""^[^ #"\\,:\[\]{}\x00-\x1f-]([^"\\,:\[\]{}\x00-\x1f]*[^ "\\,:\[\]{}\x00-\x1f])?$"""
READS_AS = r"^(true|false|null|[+-]?\d+(\.\d+)?([eE][+-]?\d+)?)$"


def cost(text: Column) -> Column:
    """Estimated size of an output: its characters, and three more for every line feed."""
    return (F.length(text) + 3 * (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))).cast("int")


def json_text(rows: Column) -> Column:
    """An array of structs as JSON."""
    return F.to_json(rows, {"ignoreNullFields": "false"})


def table_text(rows: Column, fields: list[str]) -> Column:
    """An array of flat structs as a keyed table: its length and fields once, then a line a row. Texts are quoted where a reader
    could take them for something else: empty, with outer blanks, quotes, commas, colons, backslashes, brackets, braces or control
    characters, looking like a number, a truth value or null, or beginning with a hyphen or a number sign."""
    def value(c: Column) -> Column:
        s = c.cast("string")
        plain = s.rlike(PLAIN) & ~s.rlike(READS_AS)
        quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t"), F.lit('"'))
        is_text = F.typeof(c) == "string"
        return F.coalesce(F.when(is_text & ~plain, quoted).otherwise(s), F.lit("null"))

    lines = F.transform(rows, lambda x: F.concat(F.lit("  "), F.concat_ws(",", *[value(x[f]) for f in fields])))
    return F.concat(F.lit("["), F.size(rows).cast("string"), F.lit("]{" + ",".join(fields) + "}:\n"), F.array_join(lines, "\n"))


def auto(df: DataFrame, rows: str, fields: list[str]) -> DataFrame:
    """Adds ``json_cost``, ``toon_cost``, ``format`` and the ``output`` that costs less (JSON on a tie) for each row's array of flat structs."""
    both = df.withColumns({"json": json_text(F.col(rows)), "toon": table_text(F.col(rows), fields)})
    both = both.withColumns({"json_cost": cost(F.col("json")), "toon_cost": cost(F.col("toon"))})
    less = F.col("toon_cost") < F.col("json_cost")
    return both.withColumns({"format": F.when(less, "toon").otherwise("json"), "output": F.when(less, F.col("toon")).otherwise(F.col("json"))}).drop("json", "toon")
