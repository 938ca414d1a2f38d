"""One review of a change: what it affects, what no longer has users, how the interface moves, what is usually changed along.

The four parts are plans over the same symbol, reference and diff tables; they meet only in the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ensure_checkpoints, measured_joins
from ..functions.paths import is_test_path
from ..sources import diffs as D
from ..sources import inputs as R
from . import api as A
from . import blocks as B
from . import constants as K
from . import impact as M
from . import intervals as I
from . import lexing as X
from . import liveness as L
from . import removals as V
from . import runtime as E
from . import scopes as P
from . import signatures as S
from . import snapshots as N
from . import symbols as Y


def symbol_rows(files: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Symbols with an id, (path, id, name, kind, sl, el, owner, exported, is_local, is_test, signature)."""
    s = Y.extract(files) if extracted is None else extracted
    return s.select(
        "path", "lang", F.concat_ws(":", "path", "ord").alias("id"), "name", "kind", "sl", "el", F.when(F.col("kind") == "method", F.col("container")).alias("owner"), "container",
        "exported", (~F.col("exported") & F.col("container").isNotNull() & (F.col("kind") == "function")).alias("is_local"), is_test_path(F.col("path")).alias("is_test"), "signature",
    )


def heads(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with ``head``: the line that they begin on and the two before it, where modifiers and annotations stand."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    near = symbols.select("path", "id", F.explode(F.sequence(F.greatest(F.col("sl") - 2, F.lit(0)), F.col("sl"))).alias("ln"))
    text = near.join(lines, ["path", "ln"]).groupBy("path", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("head"))
    return symbols.join(text, ["path", "id"], "left")


def affected(symbols: DataFrame, diff_lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Symbols that the diff touches, with all that ``impact.crosses_files`` reads; whether they override something is read from
    the lines before them, in ``files``."""
    added = D.added_lines(diff_lines).select("path", "line")
    hunks = D.hunks(diff_lines).drop("diff_id")
    hit = I.affected(symbols, hunks)
    real = I.touched(hit, added).select("path", "id").distinct().withColumn("has_added", F.lit(True))
    rows = hit.join(real, ["path", "id"], "left").where(F.col("has_added") | (F.col("new_count") == 0) | (F.col("added_in_hunk") == 0)).drop("has_added")
    header = added.select(F.col("path"), F.col("line").alias("sl"), F.lit(True).alias("header_added")).distinct()
    gone = D.deleted_at(diff_lines).select(F.col("path").alias("gp"), F.col("line").alias("gl")).distinct()
    deleted = symbols.join(gone, (F.col("path") == F.col("gp")) & (F.col("gl") >= F.col("sl")) & (F.col("gl") <= F.col("el")), "left_semi").select("path", "id", F.lit(True).alias("deleted_inside"))
    changes = D.signature_changes(diff_lines, rows.select("name")).select("path", "name", "old_line", "new_line")
    named = diff_lines.where("tag in ('+', '-')").select(F.col("new_path").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name")).distinct()
    rows = rows.join(header, ["path", "sl"], "left").join(deleted, ["path", "id"], "left").join(changes, ["path", "name"], "left").join(named.withColumn("named_in_change", F.lit(True)), ["path", "name"], "left")
    rows = rows.withColumn("head", F.col("signature")) if files is None else heads(rows, files.join(rows.select("path").distinct(), "path", "left_semi"))
    return rows.withColumns({
        "symbol": F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner", "name")).otherwise(F.col("name")), "signature_changed": F.col("old_line").isNotNull(),
        "is_override": X.overrides(F.col("head"), F.col("lang")), "object_literal": F.coalesce(F.col("signature").rlike(r"=\s*\{"), F.lit(False)),
    })


def facts(refs: DataFrame, files: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """References with the flags that ``impact.route`` reads: whether they mean something of their own file (JavaScript and
    TypeScript: by scope, others: by a definition in the file), whether they stand in or call a macro, and what evidence of an
    import there is."""
    r = A.direct_imports(refs.where("context = 'reference'"), imports, changed)
    scoped = F.col("lang").isin(*P.LANGS)
    shadow = refs.where(~scoped & (F.col("context") == "definition")).select("path", "name", F.lit(True).alias("defined")).distinct()
    holding = files.join(refs.where(scoped).select("path").distinct(), "path", "left_semi")
    local = P.resolve(holding).where("kind = 'function'").select("path", "name", "ln", "col", F.lit(True).alias("meant_here"))
    seen = imports.select("path", F.explode(F.regexp_extract_all("ctx", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("name"), F.lit(True).alias("evidence")).distinct()
    r = r.join(shadow, ["path", "name"], "left").join(local, ["path", "name", "ln", "col"], "left").join(seen, ["path", "name"], "left")
    macro = F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"!\s*[(\[{]"))
    return r.withColumns({
        "macro_callee": F.regexp_like("line", macro), "in_macro": F.col("line").rlike(r"\b\w+!\s*[(\[{]"), "has_evidence": F.coalesce("evidence", F.lit(False)), "local_shadow": F.coalesce("meant_here", "defined", F.lit(False)),
        "function_value": (F.col("lang") == "rust") & (F.col("role") == "value"), "reexport_move": F.lit(False),
    }).drop("evidence", "defined", "meant_here")


def impact(files: DataFrame, diff_lines: DataFrame, symbols: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(affected symbols, settled callers (path, line, route, callers, symbols), unresolved (path, symbols))."""
    ensure_checkpoints(files.sparkSession)
    symbols = symbol_rows(files).checkpoint() if symbols is None else symbols
    changed = D.changed_paths(diff_lines).select("path")
    hit = affected(symbols, diff_lines, files).where("not is_test and not is_local").checkpoint()
    cross = M.crosses_files(hit)
    wanted = cross.select("path", "lang", "symbol", "owner", "change", "name", F.col("old_line"), F.col("new_line"))
    refs = X.references(files, wanted.select("name").unionByName(cross.where("owner is not null").select(F.col("owner").alias("name"))).distinct())
    every = refs.withColumn("is_test", is_test_path(F.col("path"))).checkpoint()
    refs = every.where("context = 'reference'")
    imports = Y.imports(files).withColumnRenamed("src", "module")
    flags = facts(every, files, imports, changed).select(F.col("path").alias("ref_path"), F.col("lang").alias("ref_lang"), "name", F.col("ln").alias("line_no"), "confidence", "is_import", "is_test", "direct_import", "local_shadow", "macro_callee", "in_macro", "has_evidence", "function_value", "reexport_move")
    pairs = M.candidates(flags, wanted, refs.select(F.col("path").alias("ref_path"), "name"))
    sig = wanted.select(F.col("path").alias("source"), "symbol", S.same_arity(F.col("old_line"), F.col("new_line")).alias("same_arity")).distinct()
    routed = pairs.join(sig, ["source", "symbol"], "left").withColumn("route", M.route(X.GENERIC_NAMES))
    routed = routed.select("source", "symbol", F.col("ref_path").alias("path"), F.col("line_no").alias("line"), "route")
    defined = symbols.select(F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner", "name")).otherwise(F.col("name")).alias("symbol"), "path")
    routed = A.without_competing(routed, wanted.select("symbol", F.col("path").alias("source"), "owner"), defined)
    funcs = symbols.where("kind in ('function', 'method')").select("path", F.concat_ws(":", "sl", "name").alias("id"), F.col("sl").alias("lo"), F.col("el").alias("hi"))
    spots = routed.select("path", F.concat(F.lit("r"), F.col("line").cast("string")).alias("id"), F.col("line").alias("lo"), F.col("line").alias("hi")).distinct()
    inside = I.innermost(spots, funcs).select("path", F.col("lo").alias("line"), F.coalesce(F.substring_index("container", ":", -1), F.lit("<module>")).alias("caller"))
    settled = M.settle(routed.join(inside, ["path", "line"], "left"))
    return hit, settled, M.unresolved(settled, changed)


def dead(files: DataFrame, diff_lines: DataFrame, assets: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Exported symbols declared on added lines that nothing refers to, or tests alone: (path, name, line, status). What a
    runtime or a framework calls is none: special methods of Python, events and tests of Xojo, what ``runtime`` knows."""
    ensure_checkpoints(files.sparkSession)
    with measured_joins(files.sparkSession):
        return _dead(files, diff_lines, assets, symbols).checkpoint()


def _dead(files: DataFrame, diff_lines: DataFrame, assets: DataFrame | None, symbols: DataFrame | None) -> DataFrame:
    s = (symbol_rows(files) if symbols is None else symbols).where("not is_test and kind in ('function', 'method', 'class', 'constant', 'variable')")
    s = s.where(F.coalesce("exported", F.lit(False)) & ~F.col("name").rlike("^__.*__$"))
    xojo = files.where("lang = 'xojo'")
    if not xojo.isEmpty():
        entries = B.xojo_symbols(xojo).where("entry").select("path", "name", F.col("ln").alias("sl"))
        s = s.join(entries, ["path", "name", "sl"], "left_anti")
    added = D.added_lines(diff_lines).select(F.col("path").alias("file"), "line")
    s = E.without_entries(s, E.entries(files.join(added.select(F.col("file").alias("path")).distinct(), "path", "left_semi")))
    mine = L.touched(s.select(F.col("path").alias("file"), F.col("sl").alias("line"), "name", F.col("name").alias("key"), "lang"), added)
    refs = X.references(files, mine.select("name")).where("context = 'reference' and not is_import")
    counts = L.reference_counts(refs.select(F.col("symbol").alias("key"), is_test_path(F.col("path")).alias("is_test")))
    every = s.join(mine.select("name").distinct(), "name", "left_semi").select(F.col("path").alias("file"), F.col("sl").alias("line"), "name", F.col("name").alias("key"))
    rows = L.classify(every, counts, assets)
    return L.touched(rows, added).where("status in ('dead', 'test-only')").select(F.col("file").alias("path"), "name", "line", "status")


def dead_report(files: DataFrame, diff_lines: DataFrame, assets: DataFrame | None = None, seconds: float = Y.SECONDS) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(``dead`` rows, files that took too long or failed, totals of the scan: files, passed_over, rows, timeouts, failures). Files without
    symbols for either reason still count as users of others."""
    found, errors, totals = Y.extract_within(files, seconds)
    return dead(files, diff_lines, assets, symbol_rows(files, found)), errors, totals


def uses(files: DataFrame, names: DataFrame) -> DataFrame:
    """References (path, lang, name, ln, col, is_import, is_definition, before, line) of (name)s, without those that mean a function of their own
    file or something of an external package."""
    r = X.references(files, names).withColumn("is_definition", F.col("context") == "definition")
    holding = files.join(r.where(F.col("lang").isin(*P.LANGS)).select("path").distinct(), "path", "left_semi")
    own = P.resolve(holding).where("kind = 'function'").select("path", "name", "ln", "col").join(r.where("is_definition").select("path", "name").distinct(), ["path", "name"], "left_semi")
    r = r.join(own.withColumn("meant_here", F.lit(True)), ["path", "name", "ln", "col"], "left")
    bound = Y.imports(files).select("path", F.explode(F.regexp_extract_all("ctx", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))).alias("binding"), F.col("src").alias("module"))
    return A.without_external(r, bound, R.packages(files).select("package").distinct())


def interface(old_files: DataFrame, new_files: DataFrame, tree: DataFrame | None = None, diff_lines: DataFrame | None = None, symbols: DataFrame | None = None, old_tree: DataFrame | None = None) -> DataFrame:
    """(name, file, change, old_signature, new_signature, verdict, fate, to_file): how the exported surface of the changed files moves.

    In the whole new ``tree`` (the changed files, if none is given) the names are looked up: keys that an object lost and
    something still names break it; a function whose callers all stand on added lines, or
    pass a constant that got its new entries on added lines, is closed; a component that is only written as an
    element may become async; a removed name that nothing uses is dead (``fate``), one that no caller can miss outside (``removals``; what was replaced is dead, and told), others are kept.
    ``old_tree`` gives the old project file where it isn't among ``old_files``. Of several declarations of a
    name in a file the first one counts.
    """
    ensure_checkpoints(old_files.sparkSession)
    with measured_joins(old_files.sparkSession):
        return _interface(old_files, new_files, tree, diff_lines, symbols, old_tree).checkpoint()


def _interface(old_files: DataFrame, new_files: DataFrame, tree: DataFrame | None, diff_lines: DataFrame | None, symbols: DataFrame | None, old_tree: DataFrame | None) -> DataFrame:
    def flat(s: DataFrame) -> DataFrame:
        first = N.Window.partitionBy("path", "container", "name").orderBy("sl", "id")
        rows = A.exported_surface(s.where("not is_test").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"))
        rows = rows.select(F.concat_ws("\0", "path", "name").alias("id"), "path", "name", "kind", "signature")
        return rows.groupBy("id").agg(F.min(F.struct("signature", "kind", "path", "name")).alias("r")).select("id", "r.path", "r.name", "r.kind", "r.signature")

    tree = new_files if tree is None else tree
    o, n = flat(symbol_rows(old_files)), flat(symbol_rows(new_files) if symbols is None else symbols)
    d = N.diff(o.select(F.col("id").alias("name"), "signature"), n.select(F.col("id").alias("name"), "signature")).withColumnRenamed("name", "id")
    sides = o.withColumn("side", F.lit(0)).unionByName(n.withColumn("side", F.lit(1))).groupBy("id").agg(F.min(F.struct("side", F.col("path").alias("file"), "name", "kind")).alias("k")).select("id", "k.file", "k.name", "k.kind")
    langs = old_files.select("path", "lang").unionByName(new_files.select("path", "lang")).groupBy("path").agg(F.min("lang").alias("lang"))
    rows = d.join(sides, "id").join(langs, F.col("file") == F.col("path"), "left").drop("path").checkpoint()
    # What the rest of the tree says about the names.
    moved_names = rows.where("change in ('removed', 'modified')").select(F.substring_index("name", ".", -1).alias("name"))
    keys = rows.where(F.col("change") == "modified").select("id", F.explode(F.array_except(F.map_keys(A.members(F.col("old_signature"))), F.map_keys(A.members(F.col("new_signature"))))).alias("raw"))
    keys = keys.select("id", "raw", F.regexp_replace("raw", r"^['\"]|\??$|['\"]\??$", "").alias("key")).where("key <> ''")
    scripts = V.script_modules(old_files).join(tree.select(F.col("path").alias("file")), "file", "left_anti").select(F.col("module").alias("name"))
    refs = uses(tree, moved_names.unionByName(keys.select(F.col("key").alias("name"))).unionByName(scripts).distinct()).checkpoint()
    # A key is read behind a dot, in what may be a pattern, or as a text in quotes.
    spelled = tree.where(F.col("lang").isin(*P.LANGS)).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\"'`]([A-Za-z_$][A-Za-z0-9_$]*)[\"'`]"), F.lit(1)))).alias("key"))
    touched = refs.where("not is_definition and before in ('.', '{', ',')").select(F.col("name").alias("key")).unionByName(spelled).distinct()
    read = keys.join(touched, "key", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("raw")).alias("accessed"))
    added = None if diff_lines is None else D.added_lines(diff_lines).select("path", "line")
    rows = rows.withColumn("bare", F.substring_index("name", ".", -1))
    spots = refs if added is None else refs.join(added.select("path", F.col("line").alias("ln"), F.lit(True).alias("on_added")).distinct(), ["path", "ln"], "left")
    spots = spots.withColumn("on_added", F.coalesce("on_added", F.lit(False)) if added is not None else F.lit(False)).withColumnRenamed("name", "bare")
    if added is not None:
        wanted = rows.where("change = 'modified' and kind = 'function' and lang in ('typescript', 'tsx')").select(F.col("bare").alias("name"), K.added_required(F.col("old_signature"), F.col("new_signature")).alias("r")).where("r is not null")
        wanted = wanted.select("name", "r.*").checkpoint()
        if not wanted.isEmpty():
            calling = tree.join(refs.where("not is_definition").join(wanted.select("name"), "name", "left_semi").select("path").distinct(), "path", "left_semi")
            along = K.followed(calling, wanted, added).withColumnRenamed("name", "bare").withColumn("along", F.lit(True))
            spots = spots.join(along, ["path", "bare", "ln", "col"], "left").withColumn("on_added", F.col("on_added") | F.coalesce("along", F.lit(False))).drop("along")
    each = rows.select("id", "bare", "file", "kind", "name", F.col("lang").alias("own_lang")).join(spots.drop("lang", "line"), "bare")
    # In JavaScript and TypeScript another file's function of that name, and what means it, is none of ours.
    ours = (F.col("path") == F.col("file")) | F.col("meant_here").isNull() | ~((F.col("kind") == "function") & ~F.contains("name", F.lit(".")) & F.col("own_lang").isin(*P.LANGS))
    here, use = F.col("path") == F.col("file"), ours & ~F.col("is_definition") & ~F.col("is_import")
    n = lambda c: F.count(F.when(c, 1))
    told = each.groupBy("id").agg(
        ((n(F.col("is_definition") & here) == 1) & (n(ours & F.col("is_definition") & ~here) == 0) & (n(use & ~here) > 0) & (n(use & ~here & ~F.col("on_added")) == 0)).alias("closed"),
        F.bool_and(F.when(use, F.col("before").isin("<", "/"))).alias("only_markup"),
    )
    rows = rows.join(read, "id", "left").join(told, "id", "left")
    accessed = F.coalesce("accessed", F.array().cast("array<string>"))
    verdict = A.classify(F.col("kind"), F.col("lang"), F.col("name"), F.col("old_signature"), F.col("new_signature"), F.col("closed"), accessed, F.coalesce("only_markup", F.lit(False)))
    gone, come = (rows.where(F.col("change") == c).select("name", "kind", F.col(f"{s}_signature").alias("signature"), "file") for c, s in (("removed", "old"), ("added", "new")))
    key = lambda df: df.withColumn("nth", F.row_number().over(N.Window.partitionBy("name", "kind", "signature").orderBy("file")))
    moved = key(gone).join(key(come).withColumnRenamed("file", "to_file"), ["name", "kind", "signature", "nth"]).select("name", "file", "to_file")
    rows = rows.join(moved, ["name", "file"], "left")
    to = moved.select("name", F.col("to_file").alias("file"), F.lit(True).alias("is_target"))
    rows = rows.join(to, ["name", "file"], "left").where("is_target is null").checkpoint()
    # A move comes before a removal; what is left of a removed name decides its fate.
    removed = rows.where("change = 'removed' and to_file is null").select(F.col("bare").alias("name"), "file", F.when(F.contains("name", F.lit(".")), F.substring_index("name", ".", 1)).alias("owner"), "kind")
    # What means another file's own function is no use of what is gone. Imports of it are: they would fail.
    look = refs.where("meant_here is null").select("name", "path", "is_definition")
    none = look.select("name", "path", F.lit(False).alias("proved")).where(F.lit(False))
    fates = A.removed_dead(removed.select("name", "file", "owner"), look, none, removed.where("kind in ('class', 'struct', 'interface', 'enum', 'trait')").select("name", "file"))
    fates = fates.groupBy(F.col("name").alias("bare"), "file").agg(F.max("fate").alias("fate"))
    sources = old_files.select("path", "text") if old_tree is None else old_files.select("path", "text").unionByName(old_tree.where("path = 'pyproject.toml'").select("path", "text")).distinct()
    outside = V.outside_surface(removed, sources, tree, rows.where("change = 'added'"), refs).where("reason <> 'replaced'").select(F.col("name").alias("bare"), "file", F.lit(True).alias("outside"))
    rows = rows.join(fates, ["bare", "file"], "left").join(outside, ["bare", "file"], "left").withColumn("fate", F.when(F.col("outside"), "outside").otherwise(F.col("fate")))
    change = F.when(F.col("to_file").isNotNull(), "moved").otherwise(F.col("change"))
    return rows.select("name", "file", change.alias("change"), "old_signature", "new_signature", F.when(F.col("change") == "modified", verdict).alias("verdict"), F.when((F.col("change") == "removed") & F.col("to_file").isNull(), F.col("fate")).alias("fate"), "to_file")


def hook(unresolved: DataFrame, dead_: DataFrame, interface_: DataFrame, missing: DataFrame | None = None, strict_values: bool = False) -> DataFrame:
    """One row (json, blocking): the review with short keys. Impacts, dead code, removed names that are still used and broken ones
    block; moved and added names, removed ones that nothing uses, compatible changes and missing partners inform. A symbol whose change is compatible is no cause."""
    quiet = ["wrapper", "unused-members", "optional-tail", "optional-members", "async-component", "python-tail", "optional-argument", "closed", "same"] + ([] if strict_values else ["value"])
    calm = interface_.where(F.col("verdict").isin(*quiet)).select(F.col("name").alias("s")).distinct()
    causes = unresolved.select("path", F.explode("symbols").alias("s")).join(calm, "s", "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("s")).alias("syms"))
    listed = lambda df, row, when=None: (df if when is None else df.where(when)).agg(F.array_sort(F.collect_list(row)).alias("x"))
    pair = F.struct(F.col("name").alias("n"), F.col("file").alias("f"))
    broken = F.col("verdict") == "modified" if not strict_values else F.col("verdict").isin("modified", "value")
    parts = {
        "impacts": listed(causes, F.struct(F.col("path").alias("f"), "syms")),
        "dead": listed(dead_, F.struct(F.col("name").alias("n"), F.col("path").alias("f"), F.col("line").alias("l")), "status = 'dead'"),
        "test_only": listed(dead_, F.struct(F.col("name").alias("n"), F.col("path").alias("f"), F.col("line").alias("l")), "status = 'test-only'"),
        "rm": listed(interface_, pair, "change = 'removed' and coalesce(fate, 'kept') not in ('dead', 'outside')"), "rm_dead": listed(interface_, pair, "change = 'removed' and fate = 'dead'"), "mod": listed(interface_, pair, (F.col("change") == "modified") & broken),
        "add": listed(interface_, pair, "change = 'added'"), "mv": listed(interface_, F.struct(F.col("name").alias("n"), F.col("file").alias("from"), F.col("to_file").alias("to")), "change = 'moved'"),
        "mod_compat": listed(interface_, F.struct(F.col("name").alias("n"), F.col("file").alias("f"), F.col("verdict").alias("reason")), F.col("verdict").isin(*quiet)),
    }
    if missing is not None:
        parts["cochange"] = listed(missing, F.struct(F.col("file").alias("f"), F.col("expected_with").alias("w"), F.round(F.col("confidence") * 100).cast("int").alias("c")))
    out = None
    for name, df in parts.items():  # each has one row
        df = df.withColumnRenamed("x", name)
        out = df if out is None else out.crossJoin(F.broadcast(df))
    blocking = F.lit(False)
    for name in ("impacts", "dead", "rm", "mod"):
        blocking = blocking | (F.size(name) > 0)
    full = F.struct(*(F.when(F.size(n) > 0, F.col(n)).alias(n) for n in parts), blocking.alias("blocking"))
    return out.select(F.to_json(full).alias("json"), blocking.alias("blocking"))


def review(old_files: DataFrame, new_files: DataFrame, diffs: DataFrame, missing: DataFrame | None = None, assets: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of the review of unified diffs (diff_id, text) between two trees (path, lang, text)."""
    ensure_checkpoints(diffs.sparkSession)
    lines = D.parse(diffs).checkpoint()
    changed = D.changed_paths(lines).select("path")
    symbols = symbol_rows(new_files).checkpoint()
    hit, settled, unresolved = impact(new_files, lines, symbols)
    unresolved = unresolved.checkpoint()
    dead_ = dead(new_files, lines, assets, symbols).checkpoint()
    moves = interface(old_files.join(changed, "path", "left_semi"), new_files.join(changed, "path", "left_semi"), new_files, lines, symbols.join(changed, "path", "left_semi"), old_files).checkpoint()
    return {"affected": hit, "callers": settled, "impact": unresolved, "dead": dead_, "api": moves, "hook": hook(unresolved, dead_, moves, missing)}
