"""Changes of an exported surface: who refers to a name, what its removal means, which changes break no caller.

References are rows (path, name, ln, is_import, is_definition, ...) as the lexer gives them; all joins are equi-joins on
names or paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ensure_checkpoints, held
from ..functions.paths import EXTENSIONS
from . import signatures as S
from .dealing import deal
from .graph import closure, components, more

#: Classes and methods of a component that one tile pairs.
CLASS_TILE, METHOD_TILE = 4096, 16384


def index(names: DataFrame, refs: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """For each (name, file): how its references lie. ``internal`` counts uses in its own file, ``external`` those in
    others; ``defined`` definitions in all files; ``unused`` tells that no other file uses it; ``closed`` that it
    has one definition, some use that is no import, and all uses in other files stand on added (path, line)s."""
    r = refs.select(F.col("path").alias("rp"), F.col("name").alias("rn"), "ln", F.coalesce("is_import", F.lit(False)).alias("is_import"), F.coalesce("is_definition", F.lit(False)).alias("is_definition"))
    if added is not None:
        a = added.select(F.col("path").alias("rp"), F.col("line").alias("ln"), F.lit(True).alias("on_added")).distinct()
        r = r.join(a, ["rp", "ln"], "left")
    else:
        r = r.withColumn("on_added", F.lit(None).cast("boolean"))
    rows = names.select("name", "file").distinct().join(r, F.col("name") == F.col("rn"), "left")
    use = F.col("rp").isNotNull() & ~F.col("is_definition")
    inner, count = F.col("rp") == F.col("file"), lambda c: F.count(F.when(c, 1))
    out = rows.groupBy("name", "file").agg(
        count(use & inner & ~F.col("is_import")).alias("internal"), count(use & ~inner).alias("external"), count(F.col("is_definition")).alias("defined"),
        count(use & ~inner & ~F.col("is_import")).alias("calls"), count(use & ~inner & ~F.coalesce("on_added", F.lit(False))).alias("old_uses"),
    )
    return out.select("name", "file", "internal", "external", "defined", "calls", (F.col("external") == 0).alias("unused"), ((F.col("defined") == 1) & (F.col("calls") > 0) & (F.col("old_uses") == 0)).alias("closed"))


def without_external(refs: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """References (path, name, ...) without those that a file binds by an import (path, binding, module) of an external
    (package): the module is the package or lies below it."""
    package = F.when(F.col("module").startswith("@"), F.array_join(F.slice(F.split("module", "/"), 1, 2), "/")).otherwise(F.substring_index("module", "/", 1))
    bound = imports.withColumn("package", package).join(packages.select("package").distinct(), "package", "left_semi").select("path", F.col("binding").alias("name")).distinct()
    return refs.join(bound, ["path", "name"], "left_anti")


def removed_dead(removed: DataFrame, refs: DataFrame, origins: DataFrame, types: DataFrame) -> DataFrame:
    """Removed (name, file, owner) with ``fate``: dead or kept.

    refs (name, path, is_definition): what is left of the name; origins (name, path, proved): uses for which the file
    they come from was looked up. All of some origins proved to lead to a survivor: dead; else more than one definition
    left: kept; else no origin looked up: dead, if nothing refers to it; else kept. Then members follow the type (name, file)
    that owns them, is dead too and leaves nothing behind."""
    left = refs.groupBy("name").agg(F.count(F.when(F.col("is_definition"), 1)).alias("defs"), F.count(F.when(~F.col("is_definition"), 1)).alias("uses"))
    seen = origins.groupBy("name").agg(F.count(F.lit(1)).alias("looked_up"), F.bool_and(F.coalesce("proved", F.lit(False))).alias("proved"))
    n = lambda c: F.coalesce(c, F.lit(0))
    rows = removed.join(left, "name", "left").join(seen, "name", "left")
    fate = F.when((n("looked_up") > 0) & F.col("proved"), "dead").when(n("defs") > 1, "kept").when((n("looked_up") == 0) & (n("uses") == 0), "dead").otherwise("kept")
    rows = rows.withColumn("fate", fate)
    owners = rows.where("fate = 'dead'").join(types.select("name", "file"), ["name", "file"], "left_semi").select(F.col("name").alias("owner"), "file", F.lit(True).alias("owner_dead")).distinct()
    rows = rows.join(owners, ["owner", "file"], "left")
    follows = F.col("owner_dead") & (n("defs") == 0) & (n("uses") == 0)
    return rows.select("name", "file", "owner", F.when(F.coalesce(follows, F.lit(False)), "dead").otherwise(F.col("fate")).alias("fate"))


def direct_imports(refs: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """References (path, ...) with ``direct_import``: whether their file imports a changed (path) by its base name."""
    endings = "|".join(e for names in EXTENSIONS.values() for e in names)
    stem = lambda c: F.element_at(F.split(F.regexp_replace(c, rf"\.({endings})$", ""), r"[/\\.:]+"), -1)
    hit = imports.select("path", stem(F.col("module")).alias("stem")).join(changed.select(stem(F.col("path")).alias("stem")).distinct(), "stem", "left_semi")
    return refs.join(hit.select("path", F.lit(True).alias("direct_import")).distinct(), "path", "left").withColumn("direct_import", F.coalesce("direct_import", F.lit(False)))


def member_liveness(members: DataFrame, uses: DataFrame, parts: int | None = None) -> DataFrame:
    """Members (owner, name) with status live, test-only, dead or ambiguous, by uses (receiver, name, is_test).

    A use whose receiver is the owner counts; one whose receiver is unknown (null) makes the name ambiguous for every owner,
    and once ambiguous it stays so unless the owner itself has a counted use outside tests. Both are dealt once by name, in ``parts``."""
    given = members.select("owner", "name", F.lit(True).alias("member"), F.lit(None).cast("boolean").alias("is_test"))
    used = uses.where("name is not null").select(F.col("receiver").alias("owner"), "name", F.lit(False).alias("member"), "is_test")
    counted = lambda c: F.count(F.when(~F.col("member") & c, 1))
    known = F.col("owner").isNotNull()
    rows = deal(given.unionByName(used), parts, "name").groupBy("name", "owner").agg(
        F.count(F.when(F.col("member"), 1)).alias("times"), counted(known & ~F.col("is_test")).alias("prod"), counted(known & F.col("is_test")).alias("test"), counted(~known).alias("loose")
    )
    rows = rows.withColumn("unknown", F.max(F.col("loose") > 0).over(Window.partitionBy("name"))).where("times > 0")
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))  # a member given twice has two rows
    status = F.when(F.col("prod") > 0, "live").when(F.col("unknown"), "ambiguous").when(F.col("test") > 0, "test-only").otherwise("dead")
    return rows.select("owner", "name", "prod", "test", status.alias("status"))


def declaration_lines(candidates: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds the first line at which (name, path) is defined, by the name itself, else by what follows its last dot."""
    first = definitions.groupBy("path", "name").agg(F.min("ln").alias("ln"))
    whole = candidates.join(first.withColumnRenamed("ln", "own"), ["path", "name"], "left").withColumn("bare", F.substring_index("name", ".", -1))
    rows = whole.join(first.select("path", F.col("name").alias("bare"), F.col("ln").alias("by_bare")), ["path", "bare"], "left")
    return rows.withColumn("line", F.coalesce("own", "by_bare")).drop("own", "by_bare", "bare")


def without_competing(callers: DataFrame, symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """Callers (symbol, source, ...) without those of a symbol (symbol, source, owner) that has an owner and is defined
    in another file (symbol, path) too."""
    other = definitions.select("symbol", F.col("path").alias("elsewhere"))
    doubtful = symbols.where("owner is not null").join(other, "symbol").where("elsewhere <> source").select("symbol", "source").distinct()
    return callers.join(doubtful, ["symbol", "source"], "left_anti")


def with_same_file(callers: DataFrame, edges: DataFrame, affected: DataFrame) -> DataFrame:
    """Callers (path, line, symbol, caller) and, by calls (path, caller, callee, ln) of one file, those of affected
    (path, symbol)s that are not affected themselves; sorted by place."""
    a = affected.select("path", F.col("symbol").alias("callee")).distinct()
    inner = edges.join(a, ["path", "callee"]).join(affected.select("path", F.col("symbol").alias("caller")).distinct(), ["path", "caller"], "left_anti")
    return callers.select("path", "line", "symbol", "caller").unionByName(inner.select("path", F.col("ln").alias("line"), F.col("callee").alias("symbol"), "caller")).distinct().orderBy("path", "line", "symbol", "caller")


def visible_modules(modules: DataFrame, reexports: DataFrame, roots: DataFrame) -> DataFrame:
    """(module) reachable from (module) roots through public children (parent, module, public) and re-exports (module,
    target); what is found is carried as one table and cut by a checkpoint."""
    steps = modules.where("public").select(F.col("parent").alias("src"), F.col("module").alias("dst")).unionByName(reexports.select(F.col("module").alias("src"), F.col("target").alias("dst"))).distinct()
    ensure_checkpoints(roots.sparkSession)
    found = new = roots.select("module").distinct().checkpoint()
    while True:
        new = steps.join(new.withColumnRenamed("module", "src"), "src", "left_semi").select(F.col("dst").alias("module")).distinct().join(found, "module", "left_anti").checkpoint()
        if not new.limit(1).count():
            return found
        found = more(found, new)


def _walk(calls: DataFrame, steps: DataFrame, targets: DataFrame, declared: DataFrame) -> DataFrame:
    """(class, method, node, open, hit) of all that calls (class, method) come by over steps (node, trait).
    ``hit`` is a node that is a target, ``open`` one that is neither target nor has a method of its own. Frontier by frontier to
    the end, however deep; a node met before is not walked again."""
    ensure_checkpoints(calls.sparkSession)
    stops = targets.select(F.col("type").alias("node"), "method", F.lit(True).alias("hit")).unionByName(declared.select(F.col("class").alias("node"), "method", F.lit(False).alias("hit"))).groupBy("node", "method").agg(F.max("hit").alias("hit"))
    told = lambda df: df.join(stops, ["node", "method"], "left").select("class", "method", "node", F.col("hit").isNull().alias("open"), F.coalesce("hit", F.lit(False)).alias("hit"))
    met = new = told(calls.select("class", "method").distinct().withColumn("node", F.col("class"))).checkpoint()
    while not new.isEmpty():
        onward = new.where("open").join(steps, "node").select("class", "method", F.col("trait").alias("node")).distinct().join(met.select("class", "method", "node"), ["class", "method", "node"], "left_anti")
        new = told(onward).checkpoint()
        met = more(met, new)
    return met


def _component_traits(uses: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, component) of all classes, and (component, trait) with the ``wanted`` (trait) that its classes use, at any depth. Classes
    that use each other reach the same, so the walk is over their components, and only over what uses something itself."""
    e = uses.select("class", "trait").distinct().checkpoint()
    named = components(e.select(F.col("class").alias("src"), F.col("trait").alias("dst")))
    as_ = lambda df, c, name: df.join(named.select(F.col("node").alias(c), F.col("component").alias("of")), c, "left").withColumn(name, F.coalesce("of", c)).drop("of")
    classes = as_(e.select("class").distinct(), "class", "component").checkpoint()
    own = as_(e.join(wanted.select("trait").distinct(), "trait", "left_semi"), "class", "component").select("component", "trait").distinct().checkpoint()
    inner = e.join(e.select(F.col("class").alias("trait")).distinct(), "trait", "left_semi")
    steps = as_(as_(inner, "class", "src"), "trait", "dst").select("src", "dst").distinct().where("src is null or src <> dst")
    further = closure(steps).select(F.col("src").alias("component"), F.col("dst").alias("via")).join(own.withColumnRenamed("component", "via"), "via").select("component", "trait")
    return classes, own.unionByName(further).distinct()


def trait_targets(uses: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method, trait): methods (trait, method) of all traits (class, trait) that a class uses, at any depth; which of them
    a call reaches is for ``trait_dispatch``. The walk is over components. Classes that use each other meet their component's methods
    in tiles, so that a task's pairs are bounded, and no pair is shuffled or kept."""
    ensure_checkpoints(uses.sparkSession)
    classes, reach = _component_traits(uses, methods)
    reach, offered = held(reach, "reach"), methods.select("trait", "method").distinct()
    several = classes.groupBy("component").agg(F.count(F.lit(1)).alias("across")).where("across > 1").checkpoint()
    alone = reach.join(several, "component", "left_anti").join(offered, "trait").select(F.col("component").alias("class"), "method", "trait")
    shared = reach.join(several.select("component"), "component", "left_semi").join(offered, "trait").checkpoint()
    size = several.join(shared.groupBy("component").agg(F.count(F.lit(1)).alias("down")), "component").checkpoint()
    pairs = size.agg(F.coalesce(F.sum(F.col("across").cast("double") * F.col("down")), F.lit(0.0))).first()[0]
    parts = 1 + int(pairs // (CLASS_TILE * METHOD_TILE))
    tiles = size.select("component", F.ceil(F.col("across") / CLASS_TILE).cast("int").alias("across"), F.ceil(F.col("down") / METHOD_TILE).cast("int").alias("down"))

    def dealt(rows: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        placed = rows.join(tiles, "component").withColumn(own, F.pmod(F.xxhash64(*by), F.col(own)).cast("int"))
        return deal(placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))), parts, "component", "across", "down")

    met = dealt(classes, "across", "down", "class").join(dealt(shared, "down", "across", "trait", "method"), ["component", "across", "down"])
    return alone.unionByName(met.select("class", "method", "trait"))


def trait_target_counts(uses: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, targets): how many rows ``trait_targets`` has for each class, counted from these rows."""
    return trait_targets(uses, methods).groupBy("class").agg(F.count(F.lit(1)).alias("targets"))


def trait_dispatch(calls: DataFrame, targets: DataFrame, uses: DataFrame, declared: DataFrame, unclear: DataFrame) -> DataFrame:
    """(class, method, state, target): what a call (class, method) reaches among the ``targets`` (type, method).

    A target answers for itself. Else a class with a method of its own (``declared``: class, method) answers with that, which is no
    target: nothing is found behind it. Else its traits (``uses``: class, trait) are asked, at any depth. One target is
    ``resolved``; several, or one behind a composition with adaptations (``unclear``: class) or a cycle, are
    ``ambiguous``; none is ``none``, whatever is unclear. Null names are nobody's.
    """
    steps = uses.where("class is not null and trait is not null").select(F.col("class").alias("node"), "trait").distinct()
    asked = calls.where("class is not null and method is not null").select("class", "method").distinct()
    met = _walk(asked, steps, targets, declared)
    # A node is settled when all that it may ask is settled; what never is lies on a cycle or before one.
    composed = steps.select("node").distinct()
    walked = met.where("open").join(composed, "node", "left_semi").select("method", "node").distinct().checkpoint()
    asks = walked.join(steps, "node").join(walked.select("method", F.col("node").alias("trait")), ["method", "trait"]).select("method", "node", "trait").checkpoint()
    left = walked
    while True:
        waiting = asks.join(left.withColumnRenamed("node", "trait"), ["method", "trait"], "left_semi").select("method", "node").distinct()
        rest = left.join(waiting, ["method", "node"], "left_semi").checkpoint()
        before, now = left.count(), rest.count()
        left = rest
        if now in (0, before):
            break
    cyclic = left.withColumn("cyclic", F.lit(True))
    adapted = unclear.select(F.col("class").alias("node")).distinct().join(composed, "node", "left_semi").withColumn("adapted", F.lit(True))
    seen = met.join(adapted, "node", "left").join(cyclic, ["node", "method"], "left")
    doubtful = F.coalesce(F.col("open") & F.col("adapted"), F.lit(False)) | F.coalesce(F.col("open") & F.col("cyclic"), F.lit(False))
    out = seen.groupBy("class", "method").agg(F.min(F.when(F.col("hit"), F.col("node"))).alias("target"), F.countDistinct(F.when(F.col("hit"), F.col("node"))).alias("n"), F.max(doubtful).alias("doubtful"))
    state = F.when(F.col("n") == 0, "none").when((F.col("n") > 1) | F.col("doubtful"), "ambiguous").otherwise("resolved")
    return out.select("class", "method", state.alias("state"), F.when(state == "resolved", F.col("target")).alias("target"))


# What a change of one signature means. Objects are read from text as name -> value maps.


def members(text: Column) -> Column:
    """The entries of the first pair of braces as a map of names to the rest; optional names keep their mark."""
    inside = F.regexp_extract(text, r"\{([^{}]*)\}", 1)
    parts = F.filter(F.transform(F.split(inside, "[,;\n]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^[\w$'\"-]+\??\s*(:|$)"))
    pair = lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^:]+)", 1)).alias("k"), F.trim(F.regexp_extract(p, r":\s*(.*)$", 1)).alias("v"))
    once = F.array_distinct(F.transform(parts, lambda p: pair(p)["k"]))
    return F.map_from_arrays(once, F.transform(once, lambda k: F.element_at(F.filter(F.transform(parts, pair), lambda e: e["k"] == k), 1)["v"]))


def key_difference(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(removed keys, added keys, whether shared keys have equal values) of two maps."""
    o, n = F.map_keys(old), F.map_keys(new)
    same = F.forall(F.array_intersect(o, n), lambda k: F.element_at(old, k) == F.element_at(new, k))
    return F.array_sort(F.array_except(o, n)), F.array_sort(F.array_except(n, o)), same


def is_record(text: Column) -> Column:
    return text.rlike(r"\bRecord\s*<")


def unused_members(old: Column, new: Column, accessed: Column) -> Column:
    """A bound object lost or gained keys, none of which is ever read (``accessed``: names read as members)."""
    removed, added, same = key_difference(members(old), members(new))
    gone = is_record(old) & (F.size(removed) > 0)
    return F.coalesce(old.rlike(r"=\s*\{") & (is_record(old) == is_record(new)) & ~gone & (F.size(removed) + F.size(added) > 0) & same & ~F.arrays_overlap(removed, accessed), F.lit(False))


def optional_members(old: Column, new: Column) -> Column:
    """All old entries are there, every new one is optional."""
    removed, added, same = key_difference(members(old), members(new))
    return F.coalesce((F.size(removed) == 0) & (F.size(added) > 0) & same & F.forall(added, lambda k: k.endswith("?")), F.lit(False))


def required_members(old: Column, new: Column) -> Column:
    """Entries that callers now must give."""
    _, added, _ = key_difference(members(old), members(new))
    return F.filter(added, lambda k: ~k.endswith("?"))


def wrapped(old: Column, new: Column) -> Column:
    """A component put into memo, forwardRef or observer, or taken out, its parameters unchanged."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"\b(?:React\.)?(?:memo|forwardRef|observer)\s*(?:<[^>]*>)?\(", "("), r"[\s();=>]|\bfunction\b|\bconst\b", "")
    wraps = lambda s: s.rlike(r"\b(?:React\.)?(?:memo|forwardRef|observer)\s*(?:<[^>]*>)?\(")
    return F.coalesce((wraps(old) != wraps(new)) & (bare(old) == bare(new)), F.lit(False))


def async_component(name: Column, old: Column, new: Column, only_markup: Column) -> Column:
    """A component that became async, or stopped to be, and is used in markup alone."""
    plain = lambda s: F.regexp_replace(s, r"\basync\s+|Promise<([^<>]*)>", "$1")
    return F.coalesce(name.rlike("^[A-Z]") & (old.rlike(r"\basync\b") != new.rlike(r"\basync\b")) & (plain(old) == plain(new)) & only_markup, F.lit(False))


def optional_destructured(old: Column, new: Column) -> Column:
    """No parameters before, one with a default object now."""
    return F.coalesce((S.arity(old) == 0) & (S.arity(new) == 1) & new.rlike(r"\(\s*\{[^)]*\}\s*(?::[^=]*)?=\s*\{\s*\}\s*\)"), F.lit(False))


def property_to_field(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Removed Python properties (class, name, file) without those that became a field of the same class."""
    return removed.join(added.select("class", "name", "file").distinct(), ["class", "name", "file"], "left_anti")


def normalised(signature: Column, lang: Column) -> Column:
    """White space as one space each; without the parameters that a runtime injects (Rust commands); destructured
    TypeScript parameters by their type alone."""
    s = F.trim(F.regexp_replace(signature, r"\s+", " "))
    rust = F.regexp_replace(F.regexp_replace(s, r"\w+: (?:tauri::)?(?:State|AppHandle|Window|WebviewWindow)(?:<(?:[^<>]|<[^<>]*>)*>)?(?:, )?", ""), r", \)", ")")
    ts = F.regexp_replace(s, r"\{[^{}]*\}\s*:", "_:")
    return F.when(lang == "rust", rust).when(lang.isin("typescript", "tsx"), ts).otherwise(s)


def classify(kind: Column, lang: Column, name: Column, old: Column, new: Column, closed: Column, accessed: Column, only_markup: Column) -> Column:
    """The first that holds: same (once normalised), value, then the reasons for which no caller breaks, closed, modified."""
    ts, js = lang.isin("typescript", "tsx"), lang.isin("typescript", "tsx", "javascript")
    return (
        F.when(normalised(old, lang) == normalised(new, lang), "same")
        .when(S.value_only(kind, lang, old, new), "value")
        .when(js & wrapped(old, new), "wrapper")
        .when(js & unused_members(old, new, accessed), "unused-members")
        .when(js & optional_destructured(old, new), "optional-argument")
        .when(js & S.optional_tail(old, new), "optional-tail")
        .when(ts & optional_members(old, new), "optional-members")
        .when(js & async_component(name, old, new, only_markup), "async-component")
        .when((lang == "python") & S.python_tail(old, new), "python-tail")
        .when(F.coalesce(closed, F.lit(False)), "closed")
        .otherwise("modified")
    )


def exported_surface(symbols: DataFrame, surface_names: DataFrame | None = None) -> DataFrame:
    """(path, name, kind, signature): what a file's symbols offer: exported, no tests, no runtime entries, no locals;
    members by their owner's name; names that an export clause hands on count as exported."""
    b = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in symbols.columns else F.lit(False)
    rows = symbols
    if surface_names is not None:
        rows = rows.join(surface_names.select("path", "name", F.lit(True).alias("handed_on")).distinct(), ["path", "name"], "left")
        shown = b("exported") | F.coalesce("handed_on", F.lit(False))
    else:
        shown = b("exported")
    qualified = F.when(F.col("kind").isin("function", "method") & F.col("container").isNotNull(), F.concat_ws(".", "container", "name")).otherwise(F.col("name"))
    return rows.where(shown & ~b("is_test") & ~b("runtime_entry") & ~b("is_local")).select("path", qualified.alias("name"), "kind", F.trim(F.regexp_replace("signature", r"\s+", " ")).alias("signature"))
