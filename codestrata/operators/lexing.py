"""Identifiers with their place and context, comments and strings passed over.

A lexer is a state machine, so it runs in ``mapInPandas``, a file after another; what it gives is relational from
there on. Columns are byte offsets. It tells from the neighbouring tokens whether an identifier is defined, called,
imported or only named; a grammar knows more, and ``exact`` symbols of Python come from ``symbols``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_import_line
from .limits import frames

TOKENS = "path string, lang string, ln int, col int, name string, context string, role string, confidence string, before string, line string"
MOST_LINE = 200
#: A broadcast list of names has at most this many rows; longer ones are joined by a shuffle.
BROADCAST_NAMES = 200_000
#: As many names are pushed down to a scan as a list.
PUSHED_NAMES = 500

# How comments and strings look, by family of languages.
C_COMMENT, HASH_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", r"\#[^\n]*"
QUOTED = r'"(?:\\[\s\S]|[^"\\\n])*"?'
SINGLE = r"'(?:\\[\s\S]|[^'\\\n])*'?"
FAMILIES = {
    "c": [C_COMMENT, QUOTED, SINGLE],
    "js": [C_COMMENT, QUOTED, SINGLE, r"`(?:\\[\s\S]|[^`\\])*`?"],
    "go": [C_COMMENT, QUOTED, SINGLE, r"`[^`]*`?"],
    "rust": [C_COMMENT, r'b?r(?P<h>\#*)"[\s\S]*?"(?P=h)', QUOTED, r"'(?:\\[^'\n]+|[^'\\\n])'"],
    "python": [HASH_COMMENT, r'"""[\s\S]*?(?:"""|\Z)', r"'''[\s\S]*?(?:'''|\Z)", QUOTED, SINGLE],
    "php": [C_COMMENT, r"\#(?!\[)[^\n]*", QUOTED, SINGLE],
    "shell": [HASH_COMMENT, QUOTED, r"'[^']*'?"],
    "ruby": [HASH_COMMENT, r"^=begin[\s\S]*?(?:^=end|\Z)", QUOTED, SINGLE],
    "zig": [r"//[^\n]*", QUOTED, SINGLE],
    "xojo": [r"//[^\n]*", r"'[^\n]*", r"(?i:\brem\b)[^\n]*", r'"(?:""|[^"\n])*"?'],
}
FAMILY_OF = {
    "c": "c", "cpp": "c", "java": "c", "kotlin": "c", "swift": "c", "csharp": "c", "javascript": "js", "typescript": "js", "tsx": "js", "go": "go", "rust": "rust",
    "python": "python", "php": "php", "bash": "shell", "ruby": "ruby", "zig": "zig", "xojo": "xojo",
}
# Words after which an identifier is being defined.
DEFINING = {
    "c": ["struct", "enum", "union", "class", "namespace", "interface", "record", "fun", "object", "func", "protocol", "extension", "typealias"],
    "js": ["function", "class", "const", "let", "var", "interface", "enum", "type", "namespace"],
    "go": ["func", "type", "var", "const"],
    "rust": ["fn", "struct", "enum", "trait", "mod", "type", "static", "const", "union", "macro_rules"],
    "python": ["def", "class"],
    "php": ["class", "interface", "trait", "enum", "function", "const"],
    "shell": ["function"],
    "ruby": ["class", "module", "def"],
    "zig": ["fn", "const", "var"],
    "xojo": ["class", "module", "sub", "function", "property", "const", "interface", "event"],
}
# Languages whose identifiers are compared in any case.
ANY_CASE = ["php", "xojo"]
#: Method names so common that without their owner they say little.
GENERIC_NAMES = ["new", "get", "set", "from", "into", "handle", "create", "update", "delete", "run", "execute", "add", "remove"]

_lexers: dict[str, re.Pattern] = {}


def lexer(family: str) -> re.Pattern:
    if family not in _lexers:
        skip = "|".join(FAMILIES[family])
        ident = r"[A-Za-z_$][A-Za-z0-9_$]*" if family in ("js", "php") else r"[A-Za-z_][A-Za-z0-9_]*[?!]?" if family == "ruby" else r"[A-Za-z_][A-Za-z0-9_]*"
        _lexers[family] = re.compile(rf"(?P<skip>{skip})|(?P<id>{ident})|(?P<nl>\n)|(?P<op>[0-9][A-Za-z0-9_]*|::|->|=>|\.|\S)", re.M)
    return _lexers[family]


def is_comment(skipped: str, family: str) -> bool:
    """Whether what a lexer passes over is a comment, not a string."""
    return skipped.startswith(("//", "/*", "#", "=begin")) or family == "xojo" and not skipped.startswith('"')


def masked(text: str, lang: str) -> str:
    """The text with comments and strings blanked, line feeds kept."""
    return lexer(FAMILY_OF[lang]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m["skip"] is not None else m[0], text) if lang in FAMILY_OF else text


def synthetic(m: str, family: str) -> list[tuple[int, str]]:
    """(offset, name) that a comment or string names as if it were code: shell traps, test metadata, callable
    strings and attribute strings."""
    if family == "shell":
        return []
    if family == "php":
        if m[:1] in "'\"" and len(m) > 2 and m[-1] == m[0] and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)?", m[1:-1]):
            at = m.rfind(":") + 1 or 1
            return [(at, m[at:-1])]
        return [(x.start(1), x[1]) for x in re.finditer(r"@(?:dataProvider|depends|covers)\s+(?:[\w\\]+::)?([A-Za-z_][A-Za-z0-9_]*)", m)]
    return []


def lex(path: str, lang: str, text: str) -> Iterator[tuple]:
    """Rows of ``TOKENS`` for one file."""
    family = FAMILY_OF.get(lang)
    if family is None:
        return
    lines, starts = text.split("\n"), [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    plain = text.isascii()
    defining = frozenset(w.lower() if lang == "xojo" else w for w in DEFINING[family])
    ln, held, before, two_before = 0, None, "", ""
    # Columns and shown lines are kept running: a long line costs its length once, not once a token.
    seen, col, shown_of, shown = 0, 0, -1, ""
    typed = php_typed(text) if lang == "php" else frozenset()

    def column(at: int, line: int) -> int:
        return at - starts[line] if plain else col if at == seen else len(text[starts[line] : at].encode())

    def row(name: str, at: int, line: int, where: int, context: str, role: str, confidence: str, prior: str) -> tuple:
        nonlocal shown_of, shown
        if shown_of != line:
            shown_of, shown = line, lines[line].strip()[:MOST_LINE]
        return path, lang, line, where, name, context, role, confidence, prior, shown

    def just_before(at: int, line: int, most: int = 400) -> str:
        return text[max(starts[line], at - most) : at]

    for m in lexer(family).finditer(text):
        kind = m.lastgroup if m.lastgroup != "h" else "skip"
        at = m.start()
        if not plain:
            col = len(text[max(seen, starts[ln]) : at].encode()) + (col if seen >= starts[ln] else 0)
            seen = at
        if m["skip"] is not None:
            for off, name in synthetic(m[0], family):
                line = ln + m[0].count("\n", 0, off)
                yield row(name, at + off, line, column(at + off, line), "reference", "string", "exact", "")
            if family == "shell" and before == "trap":
                for x in re.finditer(r"[A-Za-z_][A-Za-z0-9_-]*", m[0]):
                    yield row(x[0], at + x.start(), ln, column(at + x.start(), ln), "reference", "callee", "exact", "trap")
            if family == "rust" and re.search(r"#\[[^\]\n]*(?:with|default|serialize_with|deserialize_with)\s*=\s*$", just_before(at, ln)):
                for x in re.finditer(r"[A-Za-z_][A-Za-z0-9_]*", m[0]):
                    yield row(x[0], at + x.start(), ln, column(at + x.start(), ln), "reference", "string", "exact", "")
            ln += m[0].count("\n")
            continue
        if kind == "nl":
            ln += 1
            continue
        if held is not None:  # what follows an identifier tells whether it is called
            name, begin, line, where, prior, prior2 = held
            called = m[0] == "("
            word = prior.lower() if lang == "xojo" else prior
            receiver = family == "go" and prior == ")" and lines[line].startswith("func") and re.match(r"^func\s*\([^)]*\)\s*$", lines[line][: begin - starts[line]])
            defined = word in defining or bool(receiver) or family == "python" and m[0] == "=" and text[m.end() : m.end() + 1] != "=" and begin == starts[line] or family == "shell" and called and text[m.end() : m.end() + 1] == ")"
            if family == "c" and called and not defined:
                left = just_before(begin, line)
                if re.search(r"[\w>*&\]]\s+[*&]*$", left) and not re.search(r"\b(return|new|else|throw|case|await|in)\s+$|[=(,]\s*$", left):
                    defined = True  # a type stands before it
            ignored = family == "c" and prior in ("struct", "class", "enum", "union") and m[0] == ";"
            role = "callee" if called and not defined else "member" if prior in (".", "->", "::") else "value" if prior in ("(", ",", "[") and m[0] in (",", ")", "]") else "other"
            confidence = "exact"
            if lang == "php" and prior == "->":
                confidence = "inferred" if prior2 == "$this" or prior2 in typed else "bare"
            if not ignored:
                yield row(name, begin, line, where, "definition" if defined else "reference", role, confidence, prior)
            held = None
        if kind == "id":
            held = (m[0], at, ln, column(at, ln), before, two_before)
        two_before, before = before, m[0]
    if held is not None:
        name, begin, line, where, prior, _ = held
        yield row(name, begin, line, where, "definition" if prior in defining else "reference", "other", "exact", prior)


def php_typed(text: str) -> frozenset[str]:
    """Variables that a file gives a type: after a type's name, in a @var comment, or by ``new``."""
    hinted = re.findall(r"(?:@var\s+\S+\s+|[A-Z]\w*\s+)(?=(\$[A-Za-z0-9_$]+))", text)
    return frozenset(hinted) | frozenset(re.findall(r"(\$[A-Za-z0-9_$]+)\s*=\s*new\b", text))


def tokens(files: DataFrame) -> DataFrame:
    """Identifiers of (path, lang, text) files as ``TOKENS``. Files of no known language and null texts have none."""

    def run(batches):
        names = [c.split()[0] for c in TOKENS.split(", ")]
        for b in batches:
            yield from frames((r for p, g, t in zip(b["path"], b["lang"], b["text"], strict=True) if t is not None and g is not None for r in lex(p, g, t)), names)

    return files.select("path", "lang", "text").mapInPandas(run, TOKENS)


def key(name: Column, lang: Column) -> Column:
    """What identifiers are compared by."""
    return F.when(lang.isin(*ANY_CASE), F.lower(name)).otherwise(name)


def words(files: DataFrame) -> DataFrame:
    """(path, word): the token index, every word of a file once, in lower case. What the lexer may give as a name is among them, in
    every family: numbers are taken out as it takes them, and names are cut as each family cuts them, with the names inside
    comments and strings, and those that a shell trap spells with dashes."""
    low = F.lower("text")
    cut = lambda text, name: F.filter(F.regexp_extract_all(text, F.lit(rf"[0-9][a-z0-9_]*|({name})"), F.lit(1)), lambda w: w != "")
    # Ruby's block comment ends in the middle of what looks like a word.
    freed = F.regexp_replace(low, "=end", "=end ")
    plain = cut(low, "[a-z_][a-z0-9_]*")
    family = F.when(F.col("lang").isin("javascript", "typescript", "tsx", "php"), cut(low, "[a-z_$][a-z0-9_$]*")).when(F.col("lang") == "ruby", F.concat(cut(low, "[a-z_][a-z0-9_]*[?!]?"), cut(freed, "[a-z_][a-z0-9_]*[?!]?"))).when(
        F.col("lang") == "bash", cut(low, "[a-z_][a-z0-9_-]*")
    )
    inner = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_$-]*"), F.lit(0)), lambda w: F.array(F.lower(w))))
    trap = F.when(F.col("lang") == "bash", F.transform(inner, lambda w: F.regexp_replace(w, "^[^a-z_]+", "")))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(plain, F.coalesce(family, none), F.coalesce(trap, none)))
    return files.where(F.col("text").isNotNull()).select("path", F.explode(every).alias("word")).where("word <> ''")


def save_words(files: DataFrame, folder: str) -> None:
    """Writes the token index once: sorted by word over all files, with bloom filters, so that a question reads the row groups that
    may hold its names and no text at all."""
    words(files).repartitionByRange("word").sortWithinPartitions("word", "path").write.option("parquet.bloom.filter.enabled#word", "true").mode("overwrite").parquet(folder)


def having(files: DataFrame, names: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Files that hold one of (name) as a word, in any case, by a semi-join with the token index: that of the files, or one that
    ``save_words`` wrote. A superset of the files with references; up to ``PUSHED_NAMES`` names reach the index's scan as a list,
    more are joined."""
    wanted = names.select(F.lower("name").alias("word")).where("word is not null").distinct()
    first = [r["word"] for r in wanted.limit(PUSHED_NAMES + 1).collect()]
    held = words(files) if index is None else index.select("path", "word")
    held = held.where(F.col("word").isin(*first)) if len(first) <= PUSHED_NAMES else held.join(sized(wanted), "word", "left_semi")
    return files.join(held.select("path").distinct(), "path", "left_semi")


def sized(names: DataFrame) -> DataFrame:
    """A hint to broadcast, where a count shows that the list is short."""
    return F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names


def references(files: DataFrame, names: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """All places of (name) in (path, lang, text) files: the columns of ``TOKENS``, ``symbol`` the name asked for,
    and ``is_import``. Files without any of the names never reach the lexer."""
    wanted = names.select(F.col("name").alias("symbol")).distinct()
    t = tokens(having(files, names, index)).withColumn("is_import", is_import_line(F.col("line")))
    exact = t.where(~F.col("lang").isin(*ANY_CASE)).join(sized(wanted), F.col("name") == F.col("symbol"))
    folded = t.where(F.col("lang").isin(*ANY_CASE)).join(sized(wanted), F.lower("name") == F.lower("symbol"))
    return exact.unionByName(folded)


def ordered(refs: DataFrame) -> DataFrame:
    """Definitions first, then by path and place."""
    return refs.orderBy(F.col("context") != "definition", "path", "ln", "col")


def batch(files: DataFrame, names: DataFrame) -> DataFrame:
    """(ord, name, references): one row a requested (ord, name), in that order, none of them left out."""
    spot = F.struct((F.col("context") != "definition").alias("later"), "path", "ln", "col", "context", "line")
    found = references(files, names).groupBy("symbol").agg(F.array_sort(F.collect_list(spot)).alias("references"))
    return names.join(found, F.col("name") == F.col("symbol"), "left").select("ord", "name", F.coalesce("references", F.array().cast(found.schema["references"].dataType)).alias("references")).orderBy("ord")


def import_lines(tokens_: DataFrame) -> DataFrame:
    """(path, ln) that hold an import."""
    return tokens_.where(is_import_line(F.col("line"))).select("path", "ln").distinct()


def definitions(tokens_: DataFrame) -> DataFrame:
    """(path, lang, name, ln, col): the first definition of each name of a file."""
    d = tokens_.where("context = 'definition'")
    return d.groupBy("path", "lang", "name").agg(F.min(F.struct("ln", "col")).alias("at")).select("path", "lang", "name", "at.ln", "at.col")


def go_receiver(signature: Column) -> Column:
    """The type of a method's receiver."""
    return F.nullif(F.regexp_extract(signature, r"^func\s*\(\s*(?:\w+\s+)?\*?\s*([A-Za-z_]\w*)", 1), F.lit(""))


def overrides(head: Column, lang: Column) -> Column:
    """Whether the lines before a name mark it as overriding, by modifier or annotation."""
    return F.coalesce(
        F.when(lang.isin("kotlin", "swift", "csharp", "typescript", "tsx", "cpp"), head.rlike(r"\boverride\b"))
        .when(lang == "java", head.rlike(r"@Override\b"))
        .when(lang == "php", head.rlike(r"#\[\\?Override\]"))
        .when(lang == "python", head.rlike(r"@(?:typing\.)?override\b")), F.lit(False))


def surface(files: DataFrame) -> DataFrame:
    """(path, name): what a module hands on by an export clause or a re-export."""
    one = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"export\s*\{([^}]*)\}"), F.lit(1)), lambda c: F.split(c, ",")))
    js = F.transform(one, lambda e: F.element_at(F.split(F.trim(e), r"\s+as\s+"), -1))
    uses = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"pub use ([^;]+);"), F.lit(1)), lambda u: F.split(F.regexp_replace(F.regexp_replace(u, r"^.*\{", ""), r"[{}]", ""), ",")))
    rust = F.transform(uses, lambda u: F.element_at(F.split(F.trim(F.element_at(F.split(F.trim(u), r"\s+as\s+"), -1)), "::"), -1))
    names = F.when(F.col("lang") == "rust", rust).when(F.col("lang").isin("javascript", "typescript", "tsx"), js)
    rows = files.select("path", F.explode(F.array_distinct(names)).alias("name"))
    return rows.where(F.col("name").rlike(r"^[A-Za-z_$][\w$]*$"))


def cpp_aliases(files: DataFrame) -> DataFrame:
    """(path, symbol, alias): names by which an enum or a struct lives on: its members, or its typedef."""
    enum = F.regexp_extract_all("text", F.lit(r"enum\s+(?:class\s+)?\w+\s*(?::\s*\w+\s*)?\{[^}]*\}"), F.lit(0))
    e = files.where(F.col("lang").isin("c", "cpp")).select("path", F.explode(enum).alias("d"))
    members = F.transform(F.split(F.regexp_replace(F.regexp_extract("d", r"\{([^}]*)\}", 1), r"=[^,]*", ""), ","), lambda x: F.trim(x))
    of_enum = e.select("path", F.regexp_extract("d", r"enum\s+(?:class\s+)?(\w+)", 1).alias("symbol"), F.explode(members).alias("alias"))
    typedef = F.regexp_extract_all("text", F.lit(r"typedef\s+(?:struct|enum|union)\s+\w+[^;{]*(?:\{[^}]*\}\s*)?\w+\s*;"), F.lit(0))
    t = files.where(F.col("lang").isin("c", "cpp")).select("path", F.explode(typedef).alias("d"))
    of_type = t.select("path", F.regexp_extract("d", r"typedef\s+\w+\s+(\w+)", 1).alias("symbol"), F.regexp_extract("d", r"(\w+)\s*;$", 1).alias("alias"))
    return of_enum.unionByName(of_type).where("alias rlike '^[A-Za-z_][A-Za-z0-9_]*$' and alias <> symbol").distinct()


def diagram(edges: DataFrame) -> DataFrame:
    """(path, participants, diagram): calls (path, caller, callee, ln, col) as a sequence diagram, participants by
    first appearance."""
    safe = lambda c: F.translate(c, ";#:><{}|`\"'\n\r", "_" * 13)
    call = F.struct("ln", "col", F.concat(safe(F.col("caller")), F.lit("->>"), safe(F.col("callee")), F.lit(": "), safe(F.col("callee")), F.lit("()")).alias("t"))
    calls = edges.groupBy("path").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    side = edges.select("path", "ln", "col", F.posexplode(F.array("caller", "callee")).alias("side", "name"))
    first = side.groupBy("path", "name").agg(F.min(F.struct("ln", "col", "side")).alias("at"))
    people = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("p")).select("path", F.transform("p", lambda p: p["name"]).alias("participants"))
    lines = F.concat(F.array(F.lit("sequenceDiagram")), F.transform("participants", lambda p: F.concat(F.lit("participant "), safe(p))), F.transform("calls", lambda c: c["t"]))
    return calls.join(people, "path").select("path", "participants", F.array_join(lines, "\n").alias("diagram"))


def enclosing(tokens_: DataFrame) -> DataFrame:
    """(path, ln, col, callee, caller): calls with the last function defined before them in their file, for
    languages that are only lexed; calls before the first definition are left out."""
    w = Window.partitionBy("path").orderBy("ln", "col").rowsBetween(Window.unboundedPreceding, -1)
    called = (F.col("context") == "reference") & (F.col("role") == "callee")
    rows = tokens_.withColumn("caller", F.last(F.when((F.col("context") == "definition"), F.col("name")), ignorenulls=True).over(w))
    return rows.where(called & F.col("caller").isNotNull()).select("path", "ln", "col", F.col("name").alias("callee"), "caller")


def offset(lines: DataFrame) -> DataFrame:
    """(key, ln, line, start): lines with the byte at which they begin, for lines that end in one line feed."""
    w = Window.partitionBy("key").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)))


def place(starts: DataFrame, offsets: DataFrame) -> DataFrame:
    """(key, offset, ln, col) of byte offsets, by lines with their starts."""
    s = starts.select("key", "ln", "start", F.octet_length("line").alias("size"))
    on = (F.col("offset") >= F.col("start")) & (F.col("offset") <= F.col("start") + F.col("size"))
    return offsets.join(s, "key").where(on).select("key", "offset", "ln", (F.col("offset") - F.col("start")).alias("col"))


def shortened(text: Column, most: int = 256) -> Column:
    """At most ``most`` characters, and dots where some are gone."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def dedented(text: Column) -> Column:
    """Without the white space that all lines but empty ones begin with."""
    lines = F.split(text, "\n")
    indents = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    least = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, least + 1, F.length(x))), "\n")


def resolved(path: Column) -> Column:
    """A relative path without . and .. segments; one that would leave the root is null."""
    start = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
        return F.when((s == ".") | (s == ""), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
