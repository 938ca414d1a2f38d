from pyspark.sql import functions as F

from codestrata.functions import conventions as C
from codestrata.functions import paths as P
from codestrata.sources import diffs as D
from codestrata.sources import hidden as H
from codestrata.sources.files import read_tree


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_names_that_the_listing_hides(spark, tmp_path):
    write(tmp_path, {
        "pkg/__init__.py": "x = 1\n", "pkg/a.py": "y = 1\n", "_inner/deep/_b.py": "z = 1\n", "__tests__/c.test.js": "f()\n", "top.py": "t\n", "_metadata.py": "m\n",
        "a b/_c d.py": "w\n", ".hidden/e.py": "h\n", ".git/_f.py": "g\n", "_big.py": "x" * 300, "_bytes.py": "ok\n",
    })
    (tmp_path / "_bytes.py").write_bytes(b"\xff\xfe")
    want = ["__tests__/c.test.js", "_inner/deep/_b.py", "_metadata.py", "a b/_c d.py", "pkg/__init__.py", "pkg/a.py", "top.py"]
    got = read_tree(spark, str(tmp_path), most_bytes=200)
    assert paths(got) == want
    assert paths(read_tree(spark, f"file://{tmp_path}/", most_bytes=200)) == want
    one = got.where("path = 'pkg/__init__.py'").first()
    assert (one["text"], one["length"], one["lang"]) == ("x = 1\n", 6, "python")
    assert paths(read_tree(spark, str(tmp_path), excluded_dirs=["_inner", "__tests__"], most_bytes=200)) == ["_metadata.py", "a b/_c d.py", "pkg/__init__.py", "pkg/a.py", "top.py"]


def test_contents_in_small_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "MOST_IN_FRAME", 10)
    write(tmp_path, {f"_{i}.py": f"value = {i}\n" for i in range(20)})
    files = H.listing(spark, str(tmp_path))
    got = {r["rel"]: bytes(r["content"]).decode() for r in H.contents(files, str(tmp_path)).collect()}
    assert got == {f"_{i}.py": f"value = {i}\n" for i in range(20)}
    assert H.contents(files.where("false"), str(tmp_path)).count() == 0


def test_rules_of_the_tree(spark, tmp_path):
    write(tmp_path, {".gitignore": "out/\n*.gen.py\n", "out/a.py": "a\n", "b.py": "b\n", "c.gen.py": "c\n", "sub/.gitignore": "!c.gen.py\n_d.py\n", "sub/c.gen.py": "c\n", "sub/_d.py": "d\n", "sub/_e.py": "e\n"})
    assert paths(read_tree(spark, str(tmp_path))) == ["b.py", "sub/_e.py", "sub/c.gen.py"]
    assert len(paths(read_tree(spark, str(tmp_path), ignores=False))) == 6


def test_headers_of_c_and_cpp(spark):
    cases = [
        ("c", "a.h", "int f(int class_count);\n"), ("c", "a.h", "// class Foo { }; std::x\nint f(void);"), ("c", "a.h", '/* namespace a { */ const char *s = "x::y";'), ("c", "a.h", "struct a { int b; };"),
        ("cpp", "a.h", "class Foo { };"), ("cpp", "A.H", "namespace a::b { int f(); }"), ("cpp", "a.h", "template <typename T> T f(T);"), ("cpp", "a.h", "int f(std::string s);"),
        ("cpp", "a.h", "struct A { virtual void f(); };"), ("cpp", "a.h", "constexpr int n = 1;"), ("c", "a.c", "class Foo { };"), ("cpp", "a.hpp", "int f();"), ("c", "a.h", ""),
        ("cpp", "a.h", "class Foo : public Bar {\n};"), ("c", "a.h", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n"),
    ]
    df = spark.createDataFrame(cases, "want string, path string, text string").withColumn("got", P.header_language(F.col("path"), P.language(F.col("path")), F.col("text")))
    assert [(r["text"], r["got"]) for r in df.collect()] == [(t, w) for w, _, t in cases]
    assert spark.createDataFrame([("a.h", None)], "path string, text string").select(P.header_language(F.col("path"), F.lit("c"), F.col("text"))).first()[0] == "c"


def test_all_added(spark):
    texts = {"a.py": "one\ntwo\n", "b.py": "one\n\ntwo", "c.py": "", "d.py": "\n", "e.py": "- x\n+ y\n@@ -1 +1 @@\n--- a\n", "f.py": "page\x0cbreak\nnext\n", "n.py": None}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    taken, _ = C.untracked(files, spark.createDataFrame([("z",)], "path string"))
    rows = D.parse(D.all_added(taken)).collect()
    for path, text in texts.items():
        want = [] if not text else text.removesuffix("\n").split("\n")
        mine = sorted((r["new_ln"], r["text"], r["tag"], r["old_path"]) for r in rows if r["new_path"] == path and r["tag"])
        assert [(i + 1, t) for i, t in enumerate(want)] == [m[:2] for m in mine] if want else mine == []
        assert all(m[2] == "+" for m in mine)
    added = {(r["path"], r["line"]) for r in D.added_lines(D.parse(D.all_added(files))).collect()}
    assert {p for p, _ in added} == {"a.py", "b.py", "d.py", "e.py", "f.py"}
