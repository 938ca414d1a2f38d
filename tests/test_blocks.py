"""Block extents: brackets, Ruby's keywords, Xojo's headers and tags; nested, unbalanced and commented ones."""

import random

import pytest

from codestrata.operators import blocks as B
from codestrata.operators import lexing as X

FILES = "path string, lang string, text string"


def ext(spark, lang, text, grp=None):
    files = spark.createDataFrame([("f", lang, text)], FILES)
    rows = B.extents(B.signed(B.marks(files))).collect()
    return sorted((r["sl"], r["sc"], r["el"], r["ec"], r["closed"]) for r in rows if grp is None or r["grp"] == grp)


def stack_extents(text):
    """The definition, one bracket kind after the other."""
    out, last = [], len(text)
    for a, b in ("()", "[]", "{}"):
        open_ = []
        for i, c in enumerate(text):
            if c == a:
                open_.append(i)
            elif c == b and open_:
                out.append((open_.pop(), i, True))
        out += [(i, None, False) for i in open_]
    closed = [(i, j) for i, j, k in out if k]
    marks = [i for i, c in enumerate(text) if c in "()[]{}"]
    fixed = []
    for i, j, k in out:
        if not k:
            around = [b for a, b in closed if a < i < b]
            j = min(around, key=lambda b: b - max(a for a, x in closed if x == b)) - 1 if around else marks[-1]
        fixed.append((i, j, k))
    return sorted(fixed)


def test_nested_strings_comments_and_bytes(spark):
    assert ext(spark, "javascript", "f(1); /* { */ if (a) {\n  'é}'; g({b: [1]});\n}\n", "brace") == [(0, 21, 2, 1, True), (1, 11, 1, 19, True)]
    assert ext(spark, "rust", "fn é() { '{'; }", "brace") == [(0, 8, 0, 16, True)]
    assert ext(spark, "python", "x = {'a': (1,\n 2)}", "paren") == [(0, 10, 1, 3, True)]


def test_unbalanced(spark):
    assert ext(spark, "c", ") } { a ( { b } c }", "brace") == [(0, 4, 0, 19, True), (0, 10, 0, 15, True)]
    # The open parenthesis ends with the block that holds it.
    assert ext(spark, "c", ") } { a ( { b } c }", "paren") == [(0, 8, 0, 0, False)]
    assert ext(spark, "c", "{ { }", "brace") == [(0, 0, 0, 5, False), (0, 2, 0, 5, True)]
    assert ext(spark, "c", "") == [] and ext(spark, "c", None) == [] and ext(spark, None, "{}") == []


def test_random_brackets_equal_a_stack(spark):
    rng = random.Random(12)
    texts = {f"p{k}": "".join(rng.choice("()[]{}") for _ in range(rng.randint(1, 60))) for k in range(120)}
    files = spark.createDataFrame([(p, "c", t) for p, t in texts.items()], FILES).repartition(4)
    got = {}
    for r in B.extents(B.signed(B.marks(files))).collect():
        got.setdefault(r["path"], []).append((r["lo"], r["hi"], r["closed"]))
    for p, t in texts.items():
        assert sorted(got.get(p, [])) == stack_extents(t), t


def test_ruby(spark):
    text = (
        "module A\n  class B\n    def go(x)\n      return 1 if x\n      while x do\n        y = if x then 2 else 3 end\n      end\n      x.each do |v| v.class end\n    end\n"
        "    def self.make = 4\n    def self.build\n      { if: 1, end: 2 }\n    end\n  end\nend\n"
    )
    files = spark.createDataFrame([("f", "ruby", text)], FILES)
    m = B.marks(files)
    rows = {(r["name"], r["sl"], r["el"], r["closed"]) for r in B.extents(B.signed(m)).where("grp = 'end'").collect()}
    assert {r for r in rows if r[0]} >= {("A", 0, 14, True), ("B", 1, 13, True), ("go", 2, 8, True), ("build", 10, 12, True)}
    assert {r[1:3] for r in rows if not r[0]} == {(4, 6), (5, 5), (7, 7)}
    calls = spark.createDataFrame([("f", "ruby", text.replace("return 1 if x", "helper(1)"))], FILES)
    got = B.enclosing(X.tokens(calls), B.named_blocks(B.marks(calls), X.tokens(calls))).collect()
    assert [(r["callee"], r["caller"]) for r in got if r["callee"] == "helper"] == [("helper", "go")]


def test_named_blocks_and_callers(spark):
    text = (
        "const top = (a) => {\n  if (a) { inner(a); }\n  for (const x of xs) { loop1(x); }\n};\nclass K {\n  run({a, b}) { helper(a); }\n}\n"
        "function outer(a) {\n  function nested() { deep(); }\n  after();\n}\nalone();\n"
    )
    files = spark.createDataFrame([("f.js", "javascript", text), ("g.rs", "rust", "impl S { fn go<T>(x: T) -> Vec<T> where T: A { work(x) } }\n")], FILES)
    t = X.tokens(files)
    blocks = B.named_blocks(B.marks(files), t)
    assert {(r["name"], r["sl"], r["el"]) for r in blocks.where("path = 'f.js'").collect()} == {("top", 0, 3), ("K", 4, 6), ("run", 5, 5), ("outer", 7, 10), ("nested", 8, 8)}
    got = {(r["callee"], r["caller"]) for r in B.enclosing(t, blocks).collect()}
    assert got >= {("inner", "top"), ("loop1", "top"), ("helper", "run"), ("deep", "nested"), ("after", "outer"), ("work", "go")}
    assert not any(c == "alone" for c, _ in got)


XOJO = {
    "event": ("#tag Events MyControl\n\t#tag Event\n\t\tFunction KeyDown(Key As String) As Boolean\n\t\t\tReturn False\n\t\tEnd Function\n\t#tag EndEvent\n#tag EndEvents\nSub Other()\nEnd Sub\n", {"KeyDown"}),
    "group": ("Protected Class FooTests\nInherits TestGroup\n\tSub barTest()\n\tEnd Sub\n\tSub helperUtil()\n\tEnd Sub\nEnd Class\n", {"barTest"}),
    "other": ("Protected Class Foo\nInherits Object\n\tSub barTest()\n\tEnd Sub\nEnd Class\n", set()),
    "derived": ("Protected Class Base\nInherits TestGroup\nEnd Class\nProtected Class Derived\nInherits base\n\tSub fooTest()\n\tEnd Sub\nEnd Class\n", {"fooTest"}),
    "cycle": ("#tag Class\nProtected Class A\nInherits TESTGROUP\n#tag Method\nSub Setup()\nEnd Sub\nSub TearDown\nEnd Sub\n#tag EndMethod\n#tag EndClass\nClass B\nSub xTest()\nEnd Sub\nEnd Class\n", {"Setup", "TearDown"}),
    "args": ("Protected Class FooTests\nInherits TestGroup\n\tSub fooTest(x As Integer)\n\tEnd Sub\n\tSub okTest( )\n\tEnd Sub\nEnd Class\n", {"okTest"}),
    "open": ("Class T\nInherits TestGroup\nSub aTest()\n", {"aTest"}),
}


def test_xojo_entries(spark):
    files = spark.createDataFrame([(p, "xojo", t) for p, (t, _) in XOJO.items()] + [("none", "xojo", None), ("empty", "xojo", "")], FILES)
    got = {}
    for r in B.xojo_symbols(files).where("entry").collect():
        got.setdefault(r["path"], set()).add(r["name"])
    assert got == {p: e for p, (_, e) in XOJO.items() if e}


@pytest.mark.parametrize("modifiers", ["", "Public ", "Public Shared ", "protected STATIC "])
def test_xojo_symbols(spark, modifiers):
    text = f"' Class Hidden\nClass Greeter\n  Const Name As String = \"Class X\"\n  Property p As String\r\n  {modifiers}Sub Greet(n As String)\n    x = 1\n  End Sub\nEnd Class\nModule Helpers\n Function LogIt() As Integer\n End Function\nEnd Module\n"
    rows = {(r["name"], r["kind"], r["ln"], r["col"], r["container"]) for r in B.xojo_symbols(spark.createDataFrame([("f", "xojo", text)], FILES)).collect()}
    assert rows == {
        ("Greeter", "class", 1, 6, None), ("Name", "constant", 2, 8, "Greeter"), ("p", "field", 3, 11, "Greeter"), ("Greet", "function", 4, 6 + len(modifiers), "Greeter"),
        ("Helpers", "module", 8, 7, None), ("LogIt", "function", 9, 10, "Helpers"),
    }
