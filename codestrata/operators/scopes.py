"""Lexical scopes of JavaScript and TypeScript, and which declaration a name means.

Scopes and bindings come out of the marks of a file (``blocks``) by the tokens next to them and the brackets around them; then a use is
bound to the innermost scope that binds its name, in one sorted pass over a file's name (``syntax.scope_of``).

What is a scope: the file, blocks, functions and methods from their parameters on, arrows, for statements, catch clauses.
Object literals, classes, and lists of imports and exports are not. What binds: function and class declarations, in the scope that
they stand in; let and const, there too; var, in the function around it; parameters and catch variables; names of function
expressions, in themselves; imports, in the file. Patterns bind the names at their ends, not their keys or defaults. Type annotations
bind nothing. In a scope that binds a name twice the first one counts.

A lexer knows no grammar: line ends without semicolons end a statement only before a word that begins one; regular expressions
that hold brackets or quotes confuse it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ensure_checkpoints
from . import blocks as B
from .sweep import containers
from .syntax import scope_of

LANGS = ["javascript", "typescript", "tsx"]
# Tokens after which ``function``, ``class`` or a brace belongs to an expression.
IN_EXPRESSION = ["=", "(", ",", ":", "?", "[", "&", "|", "!", "=>", "+", "-", "*", "/", "<", ">", "%", "^", "~", "...", ".", "return", "new", "typeof", "void", "await", "yield", "in", "of", "case", "delete", "throw", "extends"]
# What stands before a brace that is a block.
BEFORE_BLOCK = [")", "=>", "else", "do", "try", "finally", ";", "}", "{", "static"]
# What stands before a brace inside a type annotation.
BEFORE_TYPE = [":", "|", "&", "<", ",", "=", "(", "["]
# Words that begin a statement.
STATEMENTS = ["const", "let", "var", "function", "class", "import", "export", "return", "if", "for", "while", "do", "switch", "try", "throw", "async", "interface", "type", "enum", "break", "continue"]
# Words that are no names of methods, though parentheses and a block follow them.
NO_METHOD = ["if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "await", "new", "else", "do", "super"]
# Modifiers of parameters.
MODIFIERS = ["public", "private", "protected", "readonly"]


def _any(c: str, values: list[str]) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def _parts(marks_: DataFrame) -> DataFrame:
    """Marks with neighbours, ``inside``, what that opener is (``within``) and stands after (``led``), ``partner`` of brackets, and the next
    body and stop on the same level."""
    ext = B.extents(B.signed(marks_)).where("grp <> 'end'")
    m = B.inside(B.neighbours(marks_), ext)
    sides = ext.select("path", F.col("lo").alias("ord"), F.col("hi").alias("partner")).unionByName(ext.where("closed").select("path", F.col("hi").alias("ord"), F.col("lo").alias("partner")))
    m = m.join(sides, ["path", "ord"], "left")
    openers = m.where(F.col("text").isin("(", "[", "{")).select("path", F.col("ord").alias("inside"), F.col("text").alias("within"), F.col("p1").alias("led"), F.col("partner").alias("shut"), F.col("inside").alias("beyond"))
    m = m.join(openers, ["path", "inside"], "left")
    level = Window.partitionBy("path", "inside").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    past = Window.partitionBy("path", "inside").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    statement = F.col("leads") & _any("text", STATEMENTS) & (F.col("kind") == "id")
    body = (F.col("text") == "{") & ~_any("p1", BEFORE_TYPE)
    end = F.coalesce("shut", F.max("ord").over(Window.partitionBy("path")) + 1)
    here = F.struct("ord", "text", "partner")
    return m.withColumns({
        "body": F.last(F.when(body | (F.col("text") == ";"), here), ignorenulls=True).over(level),
        "stop": F.coalesce(F.last(F.when(F.col("text").isin(",", ";") | statement, F.col("ord")), ignorenulls=True).over(level), end) - 1,
        "ends": F.coalesce(F.last(F.when(F.col("text") == ";", F.col("ord")), ignorenulls=True).over(level), end),
        "governing": F.last(F.when((F.col("text") == ";") | statement | (F.col("text").isin("const", "let", "var") & (F.col("kind") == "id")), F.col("text")), ignorenulls=True).over(past),
    })


def scopes(parts: DataFrame) -> DataFrame:
    """(path, id, lo, hi, role): id is the number of the mark that begins it, -1 for files; role one of file, function, arrow, catch,
    for and block."""
    closers = parts.where("text = ')'").select("path", F.col("ord").alias("partner"), F.col("n1").alias("after"), F.col("n2").alias("after2"), F.col("n3").alias("after3"), F.col("body").alias("next"), "ends")
    p = parts.where("text = '(' and partner is not null").drop("ends", "body").join(closers, ["path", "partner"])
    function = (F.col("p1") == "function") | (F.col("p1") == "*") & (F.col("p2") == "function") | (F.col("pk") == "id") & ((F.col("p2") == "function") | (F.col("p2") == "*") & (F.col("p3") == "function"))
    looped = (F.col("p1") == "for") | (F.col("p1") == "await") & (F.col("p2") == "for")
    typed = (F.col("after") == ":") & (F.col("next.text") == "{") & (F.coalesce("within", F.lit("")) == "{")
    method = F.col("pk").isin("id", "str") & ~_any("p1", NO_METHOD) | (F.col("p1") == "]")
    arrow = (F.col("after") == "=>") | (F.col("after") == ":") & (F.col("after3") == "=>")
    role = (
        F.when(looped, "for").when(F.col("p1") == "catch", "catch").when(F.coalesce(function, F.lit(False)), "function").when(F.coalesce(arrow, F.lit(False)), "arrow")
        .when(method & ((F.col("after") == "{") | F.coalesce(typed, F.lit(False))), "function")
    )
    p = p.withColumn("role", role).where("role is not null")
    block = F.when(F.col("next.text") == "{", F.col("next.partner"))
    bodied = p.where("role in ('function', 'catch')").select("path", F.col("ord").alias("id"), F.coalesce(block, "partner").alias("hi"), "role", F.when(F.col("next.text") == "{", F.col("next.ord")).alias("body"))
    loops = p.where("role = 'for'").select("path", (F.col("ord") - F.when(F.col("p1") == "await", 2).otherwise(1)).alias("id"), F.when(F.col("after") == "{", block).otherwise(F.col("ends")).alias("hi"), "role", F.lit(None).cast("int").alias("body"))
    # An arrow's body is a block or ends on its level; its parameters are a list or one name.
    a = parts.where("text = '=>'").withColumn("begin", F.when((F.col("pk") == "id") & ~((F.col("p2") == ":") & (F.col("p3") == ")")), F.col("ord") - 1))
    blocks = parts.where("text = '{' and partner is not null").select("path", (F.col("ord") - 1).alias("ord"), F.col("partner").alias("bp"))
    a = a.join(blocks, ["path", "ord"], "left").withColumn("hi", F.coalesce("bp", "stop"))
    listed = p.where("role = 'arrow'").select("path", F.col("ord").alias("id"), (F.col("partner") + F.when(F.col("after") == "=>", 1).otherwise(3)).alias("at"))
    lists = listed.join(a.select("path", F.col("ord").alias("at"), "hi"), ["path", "at"]).select("path", "id", "hi", F.lit("arrow").alias("role"))
    single = a.where("begin is not null").select("path", F.col("begin").alias("id"), "hi", F.lit("arrow").alias("role"))
    bodies = bodied.where("body is not null").select("path", F.col("body").alias("id"), F.col("hi"))
    plain = parts.where((F.col("text") == "{") & F.col("partner").isNotNull() & (_any("p1", BEFORE_BLOCK) | F.col("p1").isNull())).select("path", F.col("ord").alias("id"), F.col("partner").alias("hi"))
    braces = plain.unionByName(bodies).distinct().withColumn("role", F.lit("block"))
    file = parts.groupBy("path").agg(F.max("ord").alias("hi")).select("path", F.lit(-1).alias("id"), "hi", F.lit("file").alias("role"))
    cols = ["path", "id", "hi", "role"]
    out = bodied.select(*cols).unionByName(loops.select(*cols)).unionByName(lists).unionByName(single).unionByName(braces).unionByName(file)
    return out.select("path", "id", F.col("id").alias("lo"), F.greatest("hi", "id").alias("hi"), "role")


def declarations(parts: DataFrame, scopes_: DataFrame) -> DataFrame:
    """(path, name, at, kind, hoisted): what binds a name and where: kind is function or other, hoisted var's."""
    before = F.when(F.col("p1") == "async", F.col("p2")).otherwise(F.col("p1"))
    inline = F.coalesce(before.isin(*IN_EXPRESSION), F.lit(False))
    out = lambda df, name, at, kind="other", hoisted=F.lit(False): df.select("path", name.alias("name"), at.cast("int").alias("at"), F.lit(kind).alias("kind"), hoisted.alias("hoisted"))
    word = parts.where("kind = 'id'")
    f = word.where("text = 'function'").withColumn("star", F.col("n1") == "*").withColumn("inline", inline)
    f = f.withColumn("name", F.when(F.col("star"), F.col("n2")).otherwise(F.col("n1"))).where(F.col("name").rlike(r"^[A-Za-z_$]"))
    # A declared function is bound where it stands, an expression's name where its parameters begin.
    found = out(f.where("not inline"), F.col("name"), F.col("ord"), "function").unionByName(out(f.where("inline"), F.col("name"), F.col("ord") + F.when(F.col("star"), 3).otherwise(2)))
    found = found.unionByName(out(word.where((F.col("text") == "class") & (F.col("nk") == "id") & (F.col("n1") != "extends") & ~inline), F.col("n1"), F.col("ord")))
    declaring = ["const", "let", "var"]
    first = word.where(F.col("p1").isin(*declaring) & (F.col("pk") == "id"))
    further = word.where((F.col("p1") == ",") & F.col("governing").isin(*declaring) & (F.coalesce("within", F.lit("")) != "["))
    found = found.unionByName(out(first, F.col("text"), F.col("ord"), hoisted=F.col("p1") == "var")).unionByName(out(further, F.col("text"), F.col("ord"), hoisted=F.col("governing") == "var"))
    # Parameters, directly in the list or in patterns.
    lists = scopes_.where("role in ('function', 'arrow', 'catch')").select("path", F.col("id").alias("inside"), F.lit(True).alias("listed"))
    direct = word.where(F.col("within") == "(").join(lists, ["path", "inside"]).where(F.col("p1").isin("(", ",", ".", *MODIFIERS) & F.coalesce(F.col("n1").isin(",", ")", "=", ":", "?"), F.lit(True)) & ~_any("text", MODIFIERS))
    found = found.unionByName(out(direct, F.col("text"), F.col("ord")))
    single = word.where("n1 = '=>'").where(~((F.col("p1") == ":") & (F.col("p2") == ")")))
    found = found.unionByName(out(single, F.col("text"), F.col("ord")))
    # Roots of patterns: after a declaring word, or where a parameter begins.
    openers = parts.where(F.col("text").isin("{", "[") & F.col("partner").isNotNull())
    declared = openers.where(F.col("p1").isin(*declaring) & (F.col("pk") == "id") | (F.col("p1") == ",") & F.col("governing").isin(*declaring)).withColumn("hoisted", F.coalesce(F.col("p1") == "var", F.lit(False)) | (F.col("p1") == ",") & (F.col("governing") == "var"))
    taken = openers.where(F.col("p1").isin("(", ",")).join(lists, ["path", "inside"]).withColumn("hoisted", F.lit(False))
    roots = declared.select("path", F.col("ord").alias("id"), "partner", "hoisted").unionByName(taken.select("path", F.col("ord").alias("id"), "partner", "hoisted")).distinct()
    ends = word.where(F.col("within").isin("{", "[") & F.col("p1").isin("{", "[", ",", ":", ".") & F.col("n1").isin(",", "}", "]", "="))
    points = ends.select("path", F.lit(None).cast("int").alias("id"), F.col("ord").alias("start"), F.col("ord").alias("stop"))
    home = containers(points, roots.select("path", "id", F.col("id").alias("start"), F.col("partner").alias("stop"), F.col("partner").alias("far")), ["path"], ["far"]).where("container is not null")
    home = home.select("path", F.col("start").cast("int").alias("ord"), F.col("container").alias("id")).join(roots, ["path", "id"]).select("path", "ord", F.col("hoisted").alias("by_var"))
    found = found.unionByName(out(ends.join(home, ["path", "ord"]), F.col("text"), F.col("ord"), hoisted=F.col("by_var")))
    # Imports: names between import and from that are not renamed.
    state = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    begins = (F.col("text") == "import") & ~_any("n1", ["(", "."]) & ~_any("p1", ["."])
    clause = parts.withColumn("clause", F.last(F.when(begins, "import").when(F.col("text").isin("from", ";") | (F.col("kind") == "str"), "out"), ignorenulls=True).over(state))
    named = clause.where((F.col("clause") == "import") & (F.col("kind") == "id") & F.coalesce(F.col("n1").isin(",", "}", "from"), F.lit(False)) & ~F.col("text").isin("as", "from"))
    return found.unionByName(out(named, F.col("text"), F.col("ord")))


def bindings(scopes_: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, scope, name, lo, hi, kind): each scope with the names it binds."""
    size = (F.col("hi") - F.col("lo")).alias("size")
    outer = scopes_.select("path", "id", F.col("lo").alias("start"), F.col("hi").alias("stop"), size, "role")
    at = lambda df: df.select("path", F.lit(None).cast("int").alias("id"), F.col("at").alias("start"), F.col("at").alias("stop"))
    homes = lambda df, o: containers(at(df), o, ["path"], ["size"]).select("path", F.col("start").cast("int").alias("at"), F.col("container").alias("scope"))
    lexical, hoisted = declared.where("not hoisted"), declared.where("hoisted")
    placed = lexical.join(homes(lexical, outer), ["path", "at"]).unionByName(hoisted.join(homes(hoisted, outer.where("role in ('file', 'function', 'arrow')")), ["path", "at"]))
    first = placed.groupBy("path", "scope", "name").agg(F.min_by("kind", "at").alias("kind"))
    return first.join(scopes_.select("path", F.col("id").alias("scope"), "lo", "hi"), ["path", "scope"])


def resolve(files: DataFrame) -> DataFrame:
    """(path, name, ln, col, scope, kind) of every identifier of JavaScript and TypeScript (path, lang, text) files that is not a member of
    something: the scope that binds it, as the number of the mark that begins it (-1: the file), and whether that is a
    function declared in the file (``function``) or something else (``other``). Both are null for names that nothing in the file binds."""
    ensure_checkpoints(files.sparkSession)
    files = files.where(F.col("lang").isin(*LANGS))
    if files.isEmpty():
        return files.sparkSession.createDataFrame([], "path string, name string, ln int, col int, scope int, kind string")
    m = B.marks(files).checkpoint()
    parts = _parts(m).checkpoint()
    found = scopes(parts).checkpoint()
    bound = bindings(found, declarations(parts, found)).checkpoint()
    uses = parts.where("kind = 'id'").where(F.coalesce(F.col("p1") != ".", F.lit(True))).select("path", F.col("ord").alias("use"), F.col("text").alias("name"), F.col("ord").alias("at"), "ln", "col")
    of = scope_of(uses.select("path", "use", "name", "at"), bound.select("path", "scope", "name", "lo", "hi"))
    return uses.join(of, ["path", "use"]).join(bound.select("path", "scope", "name", "kind"), ["path", "scope", "name"], "left").select("path", "name", "ln", "col", "scope", "kind")


def without_shadowed(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (path, name, ln, col, ...) without those that mean a function of their own file."""
    local = resolve(files).where("kind = 'function'").select("path", "name", "ln", "col")
    return refs.join(local, ["path", "name", "ln", "col"], "left_anti")
