"""Block extents of lexed files: where what a bracket, a keyword or a header opens ends.

The lexer gives all marks of a file in order; matching them is relational. A running sum over a file's openers (1) and
closers (-1) of one group is the depth; a closer that would take it below zero closes nothing, and what remains at one
depth of one group is opener, closer, opener, closer ... Groups are counted apart, so a stray parenthesis does not shift
the braces. What nothing closes ends with the innermost closed block around it, or with the file.

Dirty input. Files of no known language, null and empty texts have no marks; comments and strings hold none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexing as X
from .limits import frames
from .sweep import containers

MARKS = "path string, lang string, ord int, ln int, col int, text string, kind string"
#: Longer words and literals are cut: no keyword is that long.
MOST_TEXT = 120
BRACKETS = {"(": "paren", ")": "paren", "[": "square", "]": "square", "{": "brace", "}": "brace"}
# Words that open what ``end`` closes in Ruby; the second list only where a statement begins.
RUBY_ALWAYS = ["class", "module", "def", "begin", "case"]
RUBY_LEADING = ["if", "unless", "while", "until", "for"]
RUBY_LOOPS = ["while", "until", "for"]
# What declares in Xojo, what may stand before it, and the headers that an End line closes.
XOJO_MODIFIERS = ["public", "protected", "private", "global", "shared", "static"]
XOJO_KINDS = {
    "class": "class", "module": "module", "window": "class", "interface": "interface", "structure": "struct", "sub": "function", "function": "function", "property": "field",
    "const": "constant", "enum": "enum", "event": "method", "constructor": "method", "destructor": "method",
}
XOJO_CLOSED = ["class", "module", "window", "interface", "structure", "sub", "function", "enum"]
# Heads of statements whose block has no name.
CONTROL = ["if", "for", "while", "switch", "catch", "with", "match", "loop", "foreach", "elseif", "using", "lock", "guard", "when", "unless", "synchronized", "return", "await", "new"]


def stream(path: str, lang: str, text: str) -> Iterator[tuple]:
    """Rows of ``MARKS`` for one file; columns are byte offsets, kept running so that long lines cost no more than others."""
    family = X.FAMILY_OF.get(lang)
    if family is None:
        return
    plain, ln, seen, col, n = text.isascii(), 0, 0, 0, 0
    for m in X.lexer(family).finditer(text):
        at = m.start()
        col += at - seen if plain else len(text[seen:at].encode())
        seen, word = at, m[0]
        if m["nl"] is not None:
            ln, seen, col = ln + 1, m.end(), 0
            continue
        if m["skip"] is not None:
            if not X.is_comment(word, family):
                yield path, lang, n, ln, col, word[:1], "str"
                n += 1
            feeds = word.count("\n")
            if feeds:
                ln, seen, col = ln + feeds, at + word.rfind("\n") + 1, 0
            continue
        yield path, lang, n, ln, col, word[:MOST_TEXT], "id" if m["id"] is not None else "op"
        n += 1


def marks(files: DataFrame) -> DataFrame:
    """``MARKS`` of (path, lang, text) files: identifiers, strings (their first character) and everything else."""

    def run(batches):
        names = [c.split()[0] for c in MARKS.split(", ")]
        for b in batches:
            yield from frames((r for p, g, t in zip(b["path"], b["lang"], b["text"], strict=True) if t is not None and g is not None for r in stream(p, g, t)), names)

    return files.select("path", "lang", "text").mapInPandas(run, MARKS)


def neighbours(marks_: DataFrame) -> DataFrame:
    """Marks with the texts before (p1, p2, p3) and after (n1, n2, n3) them, the kinds next to them, and whether they
    lead their line."""
    w = Window.partitionBy("path").orderBy("ord")
    near = {f"p{k}": F.lag("text", k).over(w) for k in (1, 2, 3)} | {f"n{k}": F.lead("text", k).over(w) for k in (1, 2, 3)}
    return marks_.withColumns(near | {"pk": F.lag("kind").over(w), "nk": F.lead("kind").over(w), "leads": F.coalesce(F.lag("ln").over(w) < F.col("ln"), F.lit(True))})


def signed(marks_: DataFrame) -> DataFrame:
    """(path, lang, grp, ord, ln, col, size, side, name): brackets of all languages, and Ruby's keywords, with side 1 for
    openers and -1 for closers. Names are of Ruby's classes, modules and methods."""
    grp = F.element_at(F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv]), F.col("text"))
    brackets = marks_.where((F.col("kind") == "op") & F.col("text").isin(*BRACKETS)).select(
        "path", "lang", grp.alias("grp"), "ord", "ln", "col", F.lit(1).alias("size"), F.when(F.col("text").isin("(", "[", "{"), 1).otherwise(-1).alias("side"), F.lit(None).cast("string").alias("name")
    )
    all_ = Window.partitionBy("path").orderBy("ord")
    r = neighbours(marks_.where("lang = 'ruby'")).withColumns({"n4": F.lead("text", 4).over(all_), "n5": F.lead("text", 5).over(all_)})
    loops = Window.partitionBy("path", "ln").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    word = (F.col("kind") == "id") & (F.coalesce("p1", F.lit("")) != ".") & (F.coalesce("p1", F.lit("")) != ":") & (F.coalesce("n1", F.lit("")) != ":")
    leading = F.col("leads") | F.col("p1").isin("=", "(", "[", ",", "&", "|", ";", "return", "then", "else", "do")
    looped = F.coalesce(F.max((F.col("text").isin(*RUBY_LOOPS) & leading).cast("int")).over(loops), F.lit(0)) == 1
    of_self = (F.col("n1") == "self") & (F.col("n2") == ".")
    endless = (F.col("text") == "def") & F.when(of_self, (F.col("n4") == "=") & (F.col("n5") != "=")).otherwise((F.col("n2") == "=") & (F.col("n3") != "="))
    opens = (F.col("text").isin(*RUBY_ALWAYS) & ~F.coalesce(endless, F.lit(False))) | (F.col("text").isin(*RUBY_LEADING) & leading) | ((F.col("text") == "do") & ~looped)
    named = F.when(F.col("text").isin("class", "module", "def"), F.when(of_self, F.col("n3")).when(F.col("n1") != "<", F.col("n1")))
    keywords = r.withColumn("side", F.when(word & opens, 1).when(word & (F.col("text") == "end"), -1)).where("side is not null").select(
        "path", "lang", F.lit("end").alias("grp"), "ord", "ln", "col", F.length("text").alias("size"), "side", named.alias("name")
    )
    return brackets.unionByName(keywords)


def xojo_lines(files: DataFrame) -> DataFrame:
    """(path, lang, ord, ln, line, word, name, col, tail) of Xojo files: each line with the keyword and name that it declares,
    where the name stands, and what follows it; null where it declares nothing. Declarations are told by how a line begins."""
    at = files.where("lang = 'xojo' and text is not null").select("path", "lang", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    at = at.withColumn("line", F.regexp_replace("line", "\r+$", "")).withColumn("head", F.regexp_replace("line", r"^\s+|\s+$", ""))
    mods = "(?:(?:" + "|".join(XOJO_MODIFIERS) + r")\b[ \t]*)*"
    declares = r"(?i)^\s*" + mods + "(" + "|".join(XOJO_KINDS) + r")\b\s*([A-Za-z_][A-Za-z0-9_]*)(.*)$"
    part = lambda k: F.regexp_extract("line", declares, k)
    hit = F.col("line").rlike(declares)
    return at.select(
        "path", "lang", F.col("ln").alias("ord"), "ln", "line", "head", F.when(hit, F.lower(part(1))).alias("word"), F.when(hit, part(2)).alias("name"),
        F.when(hit, F.octet_length("line") - F.octet_length(part(3)) - F.octet_length(part(2))).alias("col"), F.when(hit, part(3)).alias("tail"),
    )


def xojo_signed(lines: DataFrame) -> DataFrame:
    """Like ``signed``, of Xojo's lines: headers and their End lines, #tag lines and theirs. A tag's end closes the class or
    module that it holds too."""
    closed = "|".join(XOJO_CLOSED)
    ends = F.lower(F.regexp_extract("head", rf"(?i)^end\s+({closed})\b", 1))
    tag, tag_end = F.regexp_extract("head", r"^#tag\s+([A-Za-z]+)", 1), F.regexp_extract("head", r"^#tag\s+End([A-Za-z]+)", 1)
    of = lambda grp, side, name=None: F.struct(grp.alias("grp"), F.lit(side).alias("side"), (F.lit(None).cast("string") if name is None else F.col(name)).alias("name"))
    steps = F.array(
        F.when(F.col("word").isin(*XOJO_CLOSED), of(F.col("word"), 1, "name")),
        F.when(ends != "", of(ends, -1)),
        F.when((tag != "") & (tag_end == ""), of(F.concat(F.lit("#"), F.lower(tag)), 1)),
        F.when(tag_end != "", of(F.concat(F.lit("#"), F.lower(tag_end)), -1)),
        F.when(F.lower(tag_end).isin("class", "module"), of(F.lower(tag_end), -1)),
    )
    rows = lines.select("path", "lang", "ord", "ln", F.octet_length("line").alias("size"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    return rows.select("path", "lang", "s.grp", "ord", "ln", F.lit(0).alias("col"), "size", "s.side", "s.name")


def extents(signed_: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(path, lang, grp, name, lo, hi, sl, sc, el, ec, level, closed): the block of every opener, lo and hi the numbers of
    its first and last mark.

    A closer without opener is passed over. An opener without closer ends before the end of the innermost closed block
    that holds it, of whatever group, or with its file: at ``ends`` (path, ord, ln, col), else at the last of the marks given.
    """
    w = Window.partitionBy("path", "grp").orderBy("ord")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = signed_.withColumn("sum", F.sum("side").over(run))
    s = s.withColumn("low", F.least(F.lit(0), F.min("sum").over(run)))
    s = s.withColumn("void", (F.col("side") < 0) & (F.col("low") < F.coalesce(F.lag("low").over(w), F.lit(0))))
    # An opener's depth counts itself, a closer's is that of what it closes.
    s = s.where(~F.col("void")).withColumn("level", (F.col("sum") - F.col("low") + F.when(F.col("side") < 0, 1).otherwise(0)).cast("int"))
    pair = Window.partitionBy("path", "grp", "level").orderBy("ord")
    to = F.lead(F.struct("side", "ord", "ln", "col", "size")).over(pair)
    opened = s.withColumn("to", to).where("side > 0").withColumn("closed", F.col("to").isNotNull())
    place = ["path", "lang", "grp", "name", F.col("ord").alias("lo"), F.col("ln").alias("sl"), F.col("col").alias("sc"), "level"]
    shut = opened.where("closed").select(*place, F.col("to.ord").alias("hi"), F.col("to.ln").alias("el"), (F.col("to.col") + F.col("to.size")).alias("ec"), "closed")
    if ends is None:
        ends = signed_.groupBy("path").agg(F.max(F.struct("ord", "ln", (F.col("col") + F.col("size")).alias("col"))).alias("e")).select("path", "e.*")
    loose = opened.where("not closed").select(*place, "closed").join(ends.select("path", F.col("ord").alias("fo"), F.col("ln").alias("fl"), F.col("col").alias("fc")), "path", "left")
    points = loose.select("path", F.lit(None).cast("int").alias("id"), F.col("lo").alias("start"), F.col("lo").alias("stop"))
    around = shut.select("path", F.col("hi").alias("id"), (F.col("lo") + 1).alias("start"), (F.col("hi") - 1).alias("stop"), (F.col("hi") - F.col("lo")).alias("height"))
    home = containers(points, around, ["path"], ["height"]).select("path", F.col("start").cast("int").alias("lo"), F.col("container").alias("limit"))
    spot = shut.groupBy("path", F.col("hi").alias("limit")).agg(F.min(F.struct("el", F.lit(0).alias("col"))).alias("lp"))
    loose = loose.join(home, ["path", "lo"], "left").join(spot, ["path", "limit"], "left").select(
        "path", "lang", "grp", "name", "lo", "sl", "sc", "level", F.coalesce(F.col("limit") - 1, "fo").alias("hi"), F.coalesce("lp.el", "fl").alias("el"),
        F.when(F.col("limit").isNull(), F.col("fc")).otherwise(F.lit(0)).alias("ec"), "closed",
    )
    cols = ["path", "lang", "grp", "name", "lo", "hi", "sl", "sc", "el", "ec", "level", "closed"]
    return shut.select(*cols).unionByName(loose.select(*cols))


def inside(marks_: DataFrame, extents_: DataFrame) -> DataFrame:
    """Marks with ``inside``, the number of the innermost opener around them (-1: none); brackets themselves are outside."""
    around = extents_.select("path", F.col("lo").alias("id"), (F.col("lo") + 1).alias("start"), F.when(F.col("closed"), F.col("hi") - 1).otherwise(F.col("hi")).alias("stop"), (F.col("hi") - F.col("lo")).alias("height"))
    points = marks_.select("path", F.lit(None).cast("int").alias("id"), F.col("ord").alias("start"), F.col("ord").alias("stop"))
    home = containers(points, around, ["path"], ["height"]).select("path", F.col("start").cast("int").alias("ord"), F.coalesce("container", F.lit(-1)).alias("inside"))
    return marks_.join(home, ["path", "ord"])


def named_blocks(marks_: DataFrame, tokens_: DataFrame) -> DataFrame:
    """(path, lang, name, lo, hi, sl, sc, el, ec): blocks of something that has a name, from all marks and the lexer's tokens of the
    same files. A brace takes the last name defined since the statement began; without one, that before the parentheses that
    it follows, unless a control word stands there. Ruby's ``end`` blocks bring their names along."""
    ext = extents(signed(marks_))
    ruby = ext.where("grp = 'end' and name is not null")
    brackets = ext.where("grp <> 'end'")
    m = inside(neighbours(marks_), brackets)
    defined = tokens_.where("context = 'definition'").select("path", "ln", "col", F.lit(True).alias("defined")).distinct()
    m = m.join(defined, ["path", "ln", "col"], "left")
    before = Window.partitionBy("path", "inside").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("text").isin(";", "{", "}") | (F.col("kind") == "id") & F.col("text").isin(*CONTROL)
    m = m.withColumns({
        "since": F.coalesce(F.max(F.when(begins, F.col("ord"))).over(before), F.lit(-1)),
        "last": F.max(F.when(F.col("defined"), F.struct("ord", "text"))).over(before),
        "controlled": F.last(F.when(F.col("kind") == "id", F.col("text").isin(*CONTROL)), ignorenulls=True).over(before),
    })
    heads = m.where("text = '('").select("path", F.col("ord").alias("po"), F.when((F.col("pk") == "id") & ~F.col("p1").isin(*CONTROL, "function", "fn", "func", "fun"), F.col("p1")).alias("called"))
    closers = brackets.where("grp = 'paren'").select("path", F.col("lo").alias("po"), (F.col("hi") + 1).alias("ord")).join(heads, ["path", "po"])
    braces = m.where("text = '{'").join(closers.select("path", "ord", "called"), ["path", "ord"], "left")
    name = F.coalesce(F.when(F.col("last.ord") > F.col("since"), F.col("last.text")), "called")
    got = braces.select("path", F.col("ord").alias("lo"), name.alias("found")).where("found is not null")
    named = brackets.where("grp = 'brace'").drop("name").join(got, ["path", "lo"]).withColumnRenamed("found", "name")
    cols = ["path", "lang", "name", "lo", "hi", "sl", "sc", "el", "ec"]
    return named.select(*cols).unionByName(ruby.select(*cols))


def enclosing(tokens_: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, ln, col, callee, caller): calls with the innermost named block that holds them; those in none are left out."""
    calls = tokens_.where("context = 'reference' and role = 'callee'").select("path", "ln", "col", F.col("name").alias("callee"))
    at = F.col("ln").cast("long") * (1 << 32) + F.col("col")
    place = lambda ln, col: F.col(ln).cast("long") * (1 << 32) + F.col(col)
    points = calls.select("path", F.lit(None).cast("int").alias("id"), at.alias("start"), at.alias("stop"))
    outer = blocks.select("path", F.col("lo").alias("id"), place("sl", "sc").alias("start"), place("el", "ec").alias("stop"), (F.col("hi") - F.col("lo")).alias("height"))
    home = containers(points, outer, ["path"], ["height"]).where("container is not null").select("path", F.col("start").alias("at"), F.col("container").alias("lo"))
    return calls.withColumn("at", at).join(home, ["path", "at"]).join(blocks.select("path", "lo", F.col("name").alias("caller")), ["path", "lo"]).select("path", "ln", "col", "callee", "caller")


def xojo_symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, ln, col, container, entry) of Xojo files: what they declare, in which class or module, and whether the runtime
    calls it: subs and functions under an event tag, and those without parameters called *Test, Setup or TearDown in classes
    that inherit from TestGroup in their file, at any depth. Names are compared in any case."""
    from .syntax import descendants

    lines = xojo_lines(files)
    ends = lines.groupBy("path").agg(F.max(F.struct("ord", "ln", F.octet_length("line").alias("col"))).alias("e")).select("path", "e.*")
    ext = extents(xojo_signed(lines), ends)
    owners = ext.where(F.col("grp").isin("class", "module", "window")).select("path", F.col("lo").alias("id"), (F.col("lo") + 1).alias("start"), F.col("hi").alias("stop"), (F.col("hi") - F.col("lo")).alias("height"), "name")
    events = ext.where("grp = '#event'").select("path", F.col("lo").alias("id"), (F.col("lo") + 1).alias("start"), F.col("hi").alias("stop"), (F.col("hi") - F.col("lo")).alias("height"))
    points = lines.where(F.col("word").isNotNull() | F.col("head").rlike(r"(?i)^inherits\b")).select("path", F.lit(None).cast("int").alias("id"), F.col("ord").alias("start"), F.col("ord").alias("stop"))
    at = lambda outer, as_: containers(points, outer, ["path"], ["height"]).select("path", F.col("start").cast("int").alias("ord"), F.col("container").alias(as_))
    placed = lines.join(at(owners, "owner"), ["path", "ord"]).join(at(events, "event"), ["path", "ord"])
    placed = placed.join(owners.select("path", F.col("id").alias("owner"), F.col("name").alias("container")), ["path", "owner"], "left")
    base = F.lower(F.regexp_extract("head", r"(?i)^inherits\b\s*([A-Za-z0-9_]+)", 1))
    inherits = placed.where(F.col("word").isNull() & (base != "") & F.col("container").isNotNull()).select("path", F.lower("container").alias("name"), base.alias("base"))
    # A class has one base: the last that it names.
    groups = descendants(inherits.distinct(), files.sparkSession.createDataFrame([("testgroup",)], "base string"))
    tests = groups.select("path", F.col("name").alias("lc"), F.lit(True).alias("tested")).distinct()
    declared = placed.where("word is not null").withColumn("lc", F.lower("container")).join(tests, ["path", "lc"], "left")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in XOJO_KINDS.items() for x in kv]), F.col("word"))
    bare = ~F.col("tail").rlike(r"^\s*\(") | F.col("tail").rlike(r"^\s*\(\s*\)")
    named = F.lower("name").rlike("test$|^setup$|^teardown$")
    entry = (kind == "function") & (F.col("event").isNotNull() | F.coalesce("tested", F.lit(False)) & named & bare)
    home = F.when(~kind.isin("class", "module", "interface", "struct"), F.col("container"))
    return declared.select("path", "name", kind.alias("kind"), "ln", F.col("col").cast("int").alias("col"), home.alias("container"), entry.alias("entry"))


def balance(extents_: DataFrame, path: Column | str = "path") -> DataFrame:
    """(path, grp, blocks, deepest, unclosed, longest): what the blocks of each file and group amount to; longest in marks."""
    return extents_.groupBy(path, "grp").agg(
        F.count(F.lit(1)).alias("blocks"), F.max("level").alias("deepest"), F.count(F.when(~F.col("closed"), 1)).alias("unclosed"), F.max(F.when(F.col("closed"), F.col("hi") - F.col("lo"))).alias("longest")
    )
