"""Files under a time limit, totals of one pass, and ends of blocks counted once."""

import random
import time

import pandas as pd

from codestrata.operators import blocks, lexing, limits
from codestrata.operators import symbols as S
from codestrata.operators.limits import read_within

FILES = "path string, lang string, text string"


def test_one_slow_file_costs_its_limit_only(spark):
    def reader(path, lang, text):
        if text == "slow":
            end = time.time() + 60
            while time.time() < end:
                pass
        if text == "bad":
            raise ValueError("no")
        return [(path, len(text)), (path, -1)]

    rows = [(f"f{i}", "python", "x" * (i % 7)) for i in range(1000)] + [("slow", "c", "slow"), ("bad", "c", "bad"), ("null", "c", None), ("unknown", None, "x")]
    began = time.time()
    found, errors, totals = read_within(spark.createDataFrame(rows, FILES).repartition(4), reader, "path string, size int", seconds=1.0)
    assert time.time() - began < 30
    assert totals == {"files": 1002, "passed_over": 2, "rows": 2000, "timeouts": 1, "failures": 1}
    assert {(r["path"], r["lang"], r["error"]) for r in errors.collect()} == {("slow", "c", "timeout"), ("bad", "c", "ValueError")}
    assert found.count() == 2000 and found.where("size = -1").count() == 1000 and found.where("path in ('slow', 'bad')").count() == 0


def test_symbols_equal_those_without_a_limit(spark):
    files = spark.createDataFrame([("a.py", "python", "class A:\n    def f(self):\n        return 1\n"), ("b.rs", "rust", "pub fn go() {\n}\nstruct S;\n"), ("c.py", "python", "def ("), ("d.txt", None, "x"), ("e.py", "python", "")], FILES)
    found, errors, totals = S.extract_within(files)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(found) == key(S.extract(files)) and errors.count() == 0
    assert totals == {"files": 4, "passed_over": 1, "rows": 4, "timeouts": 0, "failures": 0}
    empty, none, totals = S.extract_within(files.where("false"))
    assert empty.count() == none.count() == 0 and totals["files"] == 0


def rescanned(lines, i):
    """The definition: each line from the first on, until what it opens is closed."""
    depth, end, opened = 0, i, False
    for j in range(i, len(lines)):
        depth += lines[j].count("{") - lines[j].count("}")
        opened = opened or "{" in lines[j]
        end = j
        if opened and depth <= 0 or not opened and (lines[j].rstrip().endswith(";") or j > i + 3):
            break
    return end if opened else i


def test_ends_equal_rescanning():
    rng = random.Random(3)
    for _ in range(400):
        lines = ["".join(rng.choice(["{", "}", "a", ";", " "]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 25))]
        end_of = S.brace_ends(lines)
        assert [end_of(i) for i in range(len(lines))] == [rescanned(lines, i) for i in range(len(lines))], lines


def test_ends_are_linear():
    text = "\n".join("fn a() {" for _ in range(30000))
    began = time.time()
    assert sum(1 for _ in S.pattern_symbols("p", "rust", text)) == 30000
    assert time.time() - began < 3


def test_readers_hand_over_bounded_frames(monkeypatch):
    """However many rows a batch of files has, no frame holds more than ``FRAME_ROWS``, and none is lost."""
    monkeypatch.setattr(limits, "FRAME_ROWS", 7)
    got = [*limits.frames(((str(i), i) for i in range(30)), ["a", "b"])]
    assert [len(f) for f in got] == [7, 7, 7, 7, 2] and [b for f in got for b in f["b"]] == [*range(30)]
    assert [*limits.frames([], ["a", "b"])] == []
    for reader, rows in ((blocks.marks, 24), (lexing.tokens, 12)):
        class Files:  # stands for a table; what the task would run is called here
            def select(self, *_):
                return self

            def mapInPandas(self, run, schema):
                return [*run([pd.DataFrame([("a", "zig", "go(now)" * 6)], columns=["path", "lang", "text"])])]

        found = reader(Files())
        assert max(map(len, found)) <= 7 and sum(map(len, found)) == rows
