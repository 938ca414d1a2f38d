"""Impact of a change across files: which symbols are looked up, and where their references are routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import bare_name, same_file

# Groups of languages whose names can refer to each other.
GROUPS = {"javascript": "js", "typescript": "js", "tsx": "js", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm"}
TYPES = ["trait", "struct", "class", "interface", "enum"]


def group(lang: Column) -> Column:
    out = lang
    for name, g in GROUPS.items():
        out = F.when(lang == name, g).otherwise(out)
    return out


def crosses_files(s: DataFrame) -> DataFrame:
    """Affected symbols worth a search in other files.

    Needs kind, lang, exported, is_test, is_override, is_local, change, signature_changed, header_added,
    deleted_inside, object_literal, named_in_change (all but kind, lang and change boolean; null is false).
    """
    b = lambda c: F.coalesce(c, F.lit(False))
    callable_ = F.col("kind").isin("function", "method")
    js = F.col("lang").isin("javascript", "typescript", "tsx")
    out = (
        F.col("kind").isin("type", "module") | b(F.col("is_test")) | b(F.col("is_local"))
        | callable_ & (~b(F.col("signature_changed")) & (F.col("change") != "removed") | b(F.col("is_override")))
        | F.col("kind").isin(*TYPES) & ~b(F.col("header_added"))
        | js & (F.col("kind") == "variable") & b(F.col("object_literal")) & ~b(F.col("header_added")) & ~b(F.col("deleted_inside"))
        | ~b(F.col("exported")) | ~b(F.col("named_in_change")) | (F.col("change") == "added")
    )
    return s.where(~out)


def candidates(references: DataFrame, symbols: DataFrame, owners: DataFrame) -> DataFrame:
    """References (ref_path, ref_lang, name, line, caller, ...) to affected symbols (path, lang, symbol, owner,
    change) in other files of the same language group, outside tests; a symbol with an owner only where the
    owner is named too (owners: ref_path, name)."""
    s = symbols.select(F.col("path").alias("source"), F.col("lang").alias("source_lang"), "symbol", bare_name(F.col("symbol")).alias("key"), "owner", "change")
    joined = references.where(~F.coalesce("is_test", F.lit(False))).join(s, F.col("name") == F.col("key"))
    joined = joined.where(~same_file(F.col("ref_path"), F.col("source")) & (group(F.col("ref_lang")) == group(F.col("source_lang"))))
    named = owners.select(F.col("ref_path").alias("op"), F.col("name").alias("on")).distinct()
    with_owner = joined.where("owner is not null").join(named, (F.col("ref_path") == F.col("op")) & (F.col("owner") == F.col("on")), "left_semi")
    return joined.where("owner is null").unionByName(with_owner)


def route(generic_names: list[str]) -> Column:
    """normal, low or informational.

    Reads is_import, change, function_value, same_arity, reexport_move, confidence, name, ref_lang, owner,
    direct_import, local_shadow, macro_callee, in_macro, has_evidence. Unknown facts keep a reference normal.
    """
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    informational = b("function_value") & b("same_arity") | b("reexport_move") | b("is_import") & (F.col("change") == "modified")
    bare = (F.col("confidence") == "bare") & F.lower("name").isin([g.lower() for g in generic_names])
    js = F.col("ref_lang").isin("javascript", "typescript", "tsx") & (~F.coalesce("direct_import", F.lit(True)))
    rust = (F.col("ref_lang") == "rust") & F.col("owner").isNull() & (b("macro_callee") | ~b("in_macro") & (b("local_shadow") & F.col("has_evidence").isNotNull() | ~F.coalesce("has_evidence", F.lit(True))))
    return F.when(informational, "informational").when(~b("is_import") & (bare | js | rust), "low").otherwise("normal")


def settle(routed: DataFrame) -> DataFrame:
    """(path, line, route, callers, symbols): each (path, line, symbol) in its best route only, symbols sorted."""
    rank = F.when(F.col("route") == "normal", 0).when(F.col("route") == "low", 1).otherwise(2)
    best = routed.groupBy("path", "line", "symbol").agg(F.min(rank).alias("rank"), F.min("caller").alias("caller"))
    name = F.element_at(F.array(F.lit("normal"), F.lit("low"), F.lit("informational")), F.col("rank") + 1)
    return best.groupBy("path", "line", name.alias("route")).agg(F.array_sort(F.collect_set("caller")).alias("callers"), F.array_sort(F.collect_set("symbol")).alias("symbols"))


def unresolved(settled: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, symbols): normal callers in files that the change does not touch."""
    outside = settled.where("route = 'normal'").join(changed.select("path").distinct(), "path", "left_anti")
    return outside.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"))


def covered_moves(removed: DataFrame, reexports: DataFrame, added: DataFrame) -> DataFrame:
    """(path, name, new_path): definitions that moved while their old file exports them on: removed and added
    (path, name, header) agree in name and header, and the old path gained an export of (path, name, target)."""
    a = added.select(F.col("path").alias("new_path"), "name", "header")
    r = reexports.select("path", "name", F.col("target").alias("new_path")).distinct()
    return removed.join(a, ["name", "header"]).where("path <> new_path").join(r, ["path", "name", "new_path"]).select("path", "name", "new_path").distinct()
