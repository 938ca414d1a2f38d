import pytest

from codestrata.operators import removals as V
from codestrata.operators import review as W

OLD = {
    "gone.sh": "quiet() {\n}\nloud() {\n}\nused() {\n}\n  declare -xf other\nexport -f loud more\n",
    "lib.bash": "a() {\n}\nb() {\n}\nexport -f b_long\n",
    "app.sh": "old_name() {\n}\n",
    "tool.py": "def helper():\n    pass\n",
    "build_font.py": "def helper2():\n    pass\n",
    "__init__.py": "def root():\n    pass\n",
    "pkg/mod.py": "def inner():\n    pass\n",
    "cmd.py": "def main():\n    pass\n",
    "pyproject.toml": '[project.scripts]\nrun = "cmd:main"\n[tool.poetry.scripts]\nx = "deep.sub:f"\n',
}
REMOVED = [("quiet", "gone.sh"), ("loud", "gone.sh"), ("used", "gone.sh"), ("other", "gone.sh"), ("a", "lib.bash"), ("b", "lib.bash"), ("old_name", "app.sh"), ("helper", "tool.py"), ("helper2", "build_font.py"), ("root", "__init__.py"), ("inner", "pkg/mod.py"), ("main", "cmd.py"), (None, "x.sh"), ("n", None), ("quiet", "gone.sh")]
NAMED = [("used", "run.sh"), ("quiet", "notes.py"), ("tool", "pkg/keep.py"), ("build_font", "readme.rb"), ("b", "pkg/keep.py")]


def outside(spark, old, kept=("lib.bash", "app.sh", "pkg/keep.py"), gained=("app.sh",)):
    removed = spark.createDataFrame(REMOVED, "name string, file string")
    table = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    rows = V.outside_surface(removed, spark.createDataFrame(list(old.items()), "path string, text string"), table(kept, "path"), table(gained, "file"), spark.createDataFrame(NAMED, "name string, path string"))
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got))
    return {(n, f): r for n, f, r in got}


def test_reasons(spark):
    want = {("quiet", "gone.sh"): "shell", ("a", "lib.bash"): "shell", ("old_name", "app.sh"): "replaced", ("helper2", "build_font.py"): "script"}
    assert outside(spark, OLD) == want
    # What is named anywhere, or in a file that lost nothing else, stays.
    assert ("a", "lib.bash") not in outside(spark, OLD | {"lib.bash": "a() {\n}\ndeclare -fx a\n"})
    assert outside(spark, OLD, kept=[*OLD, "pkg/keep.py"], gained=[]).get(("helper2", "build_font.py")) is None


@pytest.mark.parametrize("text, has_script", [
    ("not [ toml", False), ('[project]\nscripts = "x"\n', False), ('[tool.poetry.scripts]\nx = { reference = "a" }\n', False), ("[project]\nname = 'x'\n", True), ('[project.gui-scripts]\nx = "build_font.cli:go"\n', False),
])
def test_project_files(spark, text, has_script):
    assert (("helper2", "build_font.py") in outside(spark, OLD | {"pyproject.toml": text})) == has_script


def test_without_project_file_and_nulls(spark):
    old = {k: v for k, v in OLD.items() if k != "pyproject.toml"} | {"null.sh": None, "pyproject.toml": None}
    assert outside(spark, old)[("main", "cmd.py")] == "script"
    empty = spark.createDataFrame([], "name string, file string")
    none = spark.createDataFrame([], "path string, text string")
    assert V.outside_surface(empty, none, none, empty, spark.createDataFrame([], "name string, path string")).count() == 0


def test_interface_leaves_them_out(spark):
    files = lambda d: spark.createDataFrame([(p, {"py": "python", "sh": "bash", "toml": None}[p.rsplit(".")[-1]], t) for p, t in d.items()], "path string, lang string, text string")
    old = files({"one.py": "def alone(a):\n    pass\n", "two.py": "def shared(a):\n    pass\n", "pkg/m.py": "def kept_fn(a):\n    pass\n", "use.py": "import two\ntwo.shared(1)\nalone(2)\n"})
    new = files({"pkg/m.py": "x = 1\n", "use.py": "import two\ntwo.shared(1)\nalone(2)\n"})
    W.ensure_checkpoints(spark)
    got = {r["name"]: r["fate"] for r in W.interface(old, new, new).where("change = 'removed'").collect()}
    assert got["alone"] == "outside" and got["shared"] == "kept" and got["kept_fn"] != "kept"
