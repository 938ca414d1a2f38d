"""The prefilter loses nothing that the lexer finds, in any family, and neither is quadratic."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codestrata.operators import lexing as X

FILES = "path string, lang string, text string"
#: Bits that the families cut differently.
BITS = [
    "helper", "other", "Helper", "$", "?", "!", "-", "_", "1", "1a", "0x", " ", " ", "\n", "(", ")", ".", "->", "::", "=", ";", ",", "'", '"', "`", "#", "//", "/*", "*/", "@", "{", "}", "é", "\\", "=begin\n", "\n=end", "trap ",
    "REM ", "rem", "r#", "b", "#[serde(with = ", ")]", "@depends ", "@dataProvider X::", "$helper", "Outer$helper", "helper!", "other?", "my-helper", "<<",
]
LANGS = ["c", "java", "javascript", "typescript", "go", "rust", "python", "php", "bash", "ruby", "zig", "xojo"]


def texts():
    rng = random.Random(17)
    out = []
    for lang in LANGS:
        for k in range(150):
            out.append((f"{lang}{k}", lang, "".join(rng.choice(BITS) for _ in range(rng.randint(1, 14)))))
    return out


@pytest.fixture(scope="module")
def files(spark):
    hand = [
        ("macro.rs", "rust", "helper!(1); other? ;"), ("bang.ts", "typescript", "helper!.y"), ("var.sh", "bash", "echo $helper"), ("nested.java", "java", "Outer$helper x;"), ("trap.sh", "bash", "trap 'my-helper' EXIT"),
        ("none.c", "c", "help er"), ("null.c", "c", None), ("empty.c", "c", ""), ("unknown", None, "helper"),
    ]
    return spark.createDataFrame(texts() + hand, FILES).repartition(6)


def all_names(files):
    return {r["name"] for r in X.tokens(files).select("name").distinct().collect()}


def test_prefilter_is_a_superset_in_every_family(spark, files):
    names = sorted(all_names(files))
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    t = X.tokens(files).select("path", F.lower("name").alias("word")).distinct()
    lost = t.join(X.words(files), ["path", "word"], "left_anti").collect()
    assert lost == []
    # Every name by itself: the files kept hold all files where the lexer finds it.
    full = X.tokens(files)
    for name in ("helper", "other", "my-helper", "$helper", "helper!", "b"):
        one = spark.createDataFrame([(name,)], "name string")
        kept = {r["path"] for r in X.having(files, one).select("path").collect()}
        found = {r["path"] for r in full.where(F.when(F.col("lang").isin(*X.ANY_CASE), F.lower("name") == name.lower()).otherwise(F.col("name") == name)).select("path").distinct().collect()}
        assert found <= kept and found
    assert X.references(files, wanted).count() >= full.count()


def test_hand_cases(spark, files):
    refs = X.references(files, spark.createDataFrame([("helper",), ("other",), ("my-helper",)], "name string"))
    got = {(r["path"], r["name"]) for r in refs.where("path like '%.%'").collect()}
    assert got == {("macro.rs", "helper"), ("macro.rs", "other"), ("bang.ts", "helper"), ("var.sh", "helper"), ("trap.sh", "my-helper")} | {("nested.java", "helper")}


def test_saved_index_answers_alike(spark, files, tmp_path):
    folder = str(tmp_path / "words")
    X.save_words(files, folder)
    index = spark.read.parquet(folder)
    names = spark.createDataFrame([("helper",), ("other",)], "name string")
    columns = ["path", "ln", "col", "name", "symbol"]
    assert sorted(map(tuple, X.references(files, names, index).select(*columns).collect())) == sorted(map(tuple, X.references(files, names).select(*columns).collect()))
    plan = index.where(F.col("word").isin("helper"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,helper)]" in plan or "In(word" in plan


def test_many_names_are_joined(spark, files, monkeypatch):
    names = spark.createDataFrame([("helper",), ("other",), ("gone",)], "name string")
    before = sorted(r["path"] for r in X.having(files, names).collect())
    monkeypatch.setattr(X, "PUSHED_NAMES", 1)
    assert sorted(r["path"] for r in X.having(files, names).collect()) == before


def took(lang, text):
    began = time.time()
    rows = sum(1 for _ in X.lex("f", lang, text))
    return time.time() - began, rows


def test_long_lines_and_many_members_are_linear():
    line = "é; " + "call(a); " * 8000
    for lang in ("java", "javascript", "go", "rust"):
        seconds, rows = took(lang, line)
        assert rows == 16001 - (lang != "x") and seconds < 1.0, (lang, seconds, rows)
    seconds, rows = took("php", "<?php\nfunction f(Repo $r) {\n" + "$r->save(); $q->go();\n" * 4000 + "}\n")
    assert seconds < 1.0
    found = list(X.lex("f", "php", "<?php $r->a(); $q->b(); /** @var T $v */ $v->c(); $n = new K; $n->d(); function f(Foo Bar $r) {}"))
    assert {r[4]: r[7] for r in found if len(r[4]) == 1 and r[4] in "abcd"} == {"a": "inferred", "b": "bare", "c": "inferred", "d": "inferred"}


def test_columns_are_bytes():
    text = "é = call(é2, x);\n'é' + y; z\n/* é\n */ w"
    got = {r[4]: (r[2], r[3]) for r in X.lex("f", "javascript", text)}
    lines = text.encode().split(b"\n")
    for name, (ln, col) in got.items():
        assert lines[ln][col : col + len(name)] == name.encode()
