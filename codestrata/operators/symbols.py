"""Symbols, calls and imports of source files.

Parsing is the one step that isn't relational: a file goes in, rows come out, in ``mapInPandas``. Python is
parsed with its own grammar. Other languages are read by line patterns with braces or indentation for extents;
that finds declarations, not everything a grammar would, and rows say so in ``exact``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .limits import SECONDS, frames, read_within

SYMBOLS = "path string, lang string, ord int, name string, kind string, sl int, sc int, el int, ec int, container string, complexity int, doc string, exported boolean, signature string, exact boolean"
CALLS = "path string, caller string, callee string, ln int, col int"
IMPORTS = "path string, src string, ln int, kind string, ctx string"
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp, ast.comprehension, ast.BoolOp, ast.match_case)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)


def complexity(node: ast.AST) -> int:
    """1 and the branches below a function, those of functions inside it left out."""
    n, stack = 1, [*ast.iter_child_nodes(node)]
    while stack:
        x = stack.pop()
        if isinstance(x, (*FUNCTIONS, ast.ClassDef)):
            continue
        n += isinstance(x, BRANCHES)
        stack += ast.iter_child_nodes(x)
    return n


def python_symbols(path: str, text: str) -> Iterator[tuple]:
    tree, lines, ord_ = ast.parse(text), text.split("\n"), 0
    names = next((ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)), None) if "__all__" in text else None

    def walk(body: list[ast.stmt], container: str | None, local: bool) -> Iterator[tuple]:
        nonlocal ord_
        for n in body:
            kind = None
            if isinstance(n, ast.ClassDef):
                kind = "class"
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if container and not local else "function"
            elif isinstance(n, ast.Assign) and not local and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                kind = "constant" if n.targets[0].id.isupper() else "variable"
            if kind:
                name = n.targets[0].id if isinstance(n, ast.Assign) else n.name
                scoped = isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))
                public = name in names if names is not None and container is None else not name.startswith("_")
                first = lines[n.lineno - 1]
                yield path, "python", ord_, name, kind, n.lineno - 1, n.col_offset, n.end_lineno - 1, n.end_col_offset, container, complexity(n) if kind in ("function", "method") else None, ast.get_docstring(n) if scoped else None, public and not local, first.strip(), True
                ord_ += 1
                if scoped:
                    yield from walk(n.body, name, local or kind != "class")
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                yield from walk([*n.body, *getattr(n, "orelse", []), *getattr(n, "finalbody", [])], container, local)

    yield from walk(tree.body, None, False)


# One pattern a language: named groups k (keyword) and n (name).
DECLARATIONS = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?P<k>fn|struct|enum|trait|mod|type|static|const)\s+(?P<n>\w+)",
    "go": r"^(?P<k>func|type|var|const)\s+(?:\([^)]*\)\s*)?(?P<n>\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<k>function\*?|class|const|let|var|interface|enum|type)\s+(?P<n>[\w$]+)",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed|open|internal|data|override)\s+)*(?P<k>class|interface|enum|record|fun|object)\s+(?P<n>\w+)",
    "php": r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?P<k>class|interface|trait|enum|function|const)\s+(?P<n>\w+)",
    "ruby": r"^\s*(?P<k>class|module|def)\s+(?:self\.)?(?P<n>[\w?!]+)",
    "bash": r"^\s*(?P<k>function\s+)?(?P<n>[\w-]+)\s*\(\)\s*\{?",
    "c": r"^(?P<k>struct|enum|union|class|namespace)\s+(?P<n>\w+)",
    "swift": r"^\s*(?:(?:public|private|internal|open|static|final)\s+)*(?P<k>func|class|struct|enum|protocol|extension)\s+(?P<n>\w+)",
    "zig": r"^\s*(?:pub\s+)?(?P<k>fn|const|var)\s+(?P<n>\w+)",
    "xojo": r"(?i)^\s*(?:(?:protected|private|public|shared)\s+)*(?P<k>class|module|sub|function|property|const)\s+(?P<n>\w+)",
}
ALIKE = {"typescript": "javascript", "tsx": "javascript", "kotlin": "java", "csharp": "java", "cpp": "c"}
# The kind that a keyword declares.
KINDS = {
    "fn": "function", "func": "function", "fun": "function", "function": "function", "function*": "function", "def": "function", "sub": "function",
    "class": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface", "protocol": "interface", "record": "class", "object": "class", "extension": "class", "union": "struct",
    "mod": "module", "module": "module", "namespace": "module", "type": "type", "static": "variable", "var": "variable", "let": "variable", "property": "variable", "const": "constant",
}


def brace_ends(lines: list[str]) -> Callable[[int], int]:
    """The line where what begins on a line ends: where the braces that open on it, or within four lines and before a semicolon at a
    line's end, are closed again; else the line itself. All lines are counted once; a question follows falls of the depth."""
    n = len(lines)
    depth, opens, stops, lower = [0] * n, [n] * (n + 1), [n] * (n + 1), [n] * n
    at = 0
    for j, line in enumerate(lines):
        at += line.count("{") - line.count("}")
        depth[j] = at
    waiting: list[int] = []
    for j in range(n - 1, -1, -1):
        opens[j] = j if "{" in lines[j] else opens[j + 1]
        stops[j] = j if lines[j].rstrip().endswith(";") else stops[j + 1]
        while waiting and depth[waiting[-1]] >= depth[j]:
            waiting.pop()
        lower[j] = waiting[-1] if waiting else n
        waiting.append(j)

    def end_of(i: int) -> int:
        j = opens[i]
        if j == n or min(stops[i], i + 4) < j:
            return i
        base = depth[i - 1] if i else 0
        while j < n and depth[j] > base:
            j = lower[j]
        return min(j, n - 1)

    return end_of


def pattern_symbols(path: str, lang: str, text: str) -> Iterator[tuple]:
    pattern = re.compile(DECLARATIONS[ALIKE.get(lang, lang)])
    lines = text.split("\n")
    end_of = brace_ends(lines)
    for ord_, (i, m) in enumerate((i, m) for i, line in enumerate(lines) if (m := pattern.match(line))):
        end = end_of(i)
        kind = KINDS.get((m["k"] or "function").strip().lower(), "function")
        line = lines[i]
        exported = {"rust": "pub " in line or "pub(" in line, "go": m["n"][:1].isupper(), "javascript": line.lstrip().startswith("export")}.get(ALIKE.get(lang, lang), not re.search(r"\bprivate\b", line))
        yield path, lang, ord_, m["n"], kind, i, m.start("n"), end, len(lines[end]), None, None, None, exported, line.strip(), False


def file_symbols(path: str, lang: str, text: str) -> list[tuple]:
    """Rows of ``SYMBOLS`` of one file; one that doesn't parse has none."""
    if lang == "python":
        try:
            return [*python_symbols(path, text)]
        except (SyntaxError, ValueError, RecursionError):
            return []
    return [*pattern_symbols(path, lang, text)] if ALIKE.get(lang, lang) in DECLARATIONS else []


def extract_within(files: DataFrame, seconds: float = SECONDS) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(symbols, errors, totals): like ``extract``, with a time limit a file; see ``limits.read_within``."""
    return read_within(files, file_symbols, SYMBOLS, seconds)


def extract(files: DataFrame) -> DataFrame:
    """Symbols of (path, lang, text) files. A file that doesn't parse is read by line patterns; one in no known
    language has no rows."""

    def run(batches):
        for b in batches:
            found = (r for p, g, t in zip(b["path"], b["lang"], b["text"], strict=True) if t is not None and g is not None for r in file_symbols(p, g, t))
            for out in frames(found, [c.split()[0] for c in SYMBOLS.split(", ")]):
                yield out.astype({"complexity": "Int32"})

    return files.select("path", "lang", "text").mapInPandas(run, SYMBOLS)


def calls(files: DataFrame, top: bool = False) -> DataFrame:
    """Call edges of Python files: the enclosing function, what it calls, where. Calls outside functions are left out
    unless ``top`` asks for them, as those of <module>."""

    def one(path: str, text: str) -> list[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        out, stack = [], [(tree, "<module>")]
        while stack:
            node, caller = stack.pop()
            for child in ast.iter_child_nodes(node):
                inner = child.name if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else caller
                if isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name and (top or caller != "<module>"):
                        out.append((path, caller, name, child.lineno - 1, child.col_offset))
                stack.append((child, inner))
        return out

    def run(batches):
        for b in batches:
            found = (r for p, g, t in zip(b["path"], b["lang"], b["text"], strict=True) if g == "python" and t is not None for r in one(p, t))
            yield from frames(found, [c.split()[0] for c in CALLS.split(", ")])

    return files.select("path", "lang", "text").mapInPandas(run, CALLS)


def callees(files: DataFrame) -> DataFrame:
    """(path, callee): all that a file calls, at its top too."""
    return calls(files, top=True).select("path", "callee").distinct()


IMPORT_PATTERNS = [
    ("python", "import", r"^\s*import\s+([\w.]+)"),
    ("python", "import", r"^\s*from\s+([\w.]+)\s+import\b"),
    ("rust", "use", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    ("javascript", "import", r"^\s*import\b.*?[\"']([^\"']+)[\"']"),
    ("javascript", "export", r"^\s*export\b.*?from\s*[\"']([^\"']+)[\"']"),
    ("javascript", "require", r"\brequire\(\s*[\"']([^\"']+)[\"']"),
    ("java", "import", r"^\s*import\s+(?:static\s+)?([\w.*]+)"),
    ("c", "include", r"^\s*#\s*include\s+[<\"]([^>\"]+)"),
    ("php", "use", r"^\s*use\s+([\w\\]+)"),
    ("ruby", "require", r"^\s*require(?:_relative)?\s+[\"']([^\"']+)"),
    ("go", "import", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    ("swift", "import", r"^\s*import\s+(\w+)"),
    ("zig", "import", r"@import\(\"([^\"]+)\"\)"),
]


def imports(files: DataFrame) -> DataFrame:
    """Import edges, by line, with built-in functions only."""
    from .references import lines

    family = F.col("lang")
    for name, like in ALIKE.items():
        family = F.when(F.col("lang") == name, like).otherwise(family)
    rows = lines(files.withColumn("family", family), "path", "text", "family")
    src, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, k, pattern in reversed(IMPORT_PATTERNS):
        hit = F.regexp_extract("line", pattern, 1)
        ok = (F.col("family") == lang) & (hit != "")
        src, kind = F.when(ok, hit).otherwise(src), F.when(ok, F.lit(k)).otherwise(kind)
    return rows.select(F.col("key").alias("path"), src.alias("src"), "ln", kind.alias("kind"), F.trim("line").alias("ctx")).where("src is not null")
