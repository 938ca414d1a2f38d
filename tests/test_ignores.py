"""Ignore files against what git itself says, and cases by hand."""

import os
import random
import subprocess

import pytest

from codestrata.sources import ignores as G

IGNORES = {
    ".gitignore": "# comment\n\n*.log\n!keep.log\n/build\ntarget/\ndoc/*.txt\n**/gen\nvendor/**\n!vendor/own.c\na/**/z\n\\#odd\n\\!bang\nsp\\ \ntrail   \n[ab].c\n[!x-z]9\nq?\n[open\n*.tmp/\n\r\n",
    "sub/.gitignore": "!*.log\n/only\nx/y\n*.c\n",
    "sub/deep/.gitignore": "!a.c\n",
    "target/.gitignore": "!*\n",
}
PATHS = [
    "a.log", "keep.log", "sub/b.log", "build", "build/x", "sub/build", "target", "target/a", "target/keep.log", "sub/target/b", "doc/a.txt", "doc/s/a.txt", "sub/doc/a.txt", "gen", "x/gen/f", "vendor/own.c", "vendor/l/m",
    "a/z", "a/b/z", "a/b/c/z", "a/zz", "#odd", "!bang", "sp ", "trail", "a.c", "b.c", "c.c", "sub/c.c", "sub/deep/a.c", "sub/deep/b.c", "sub/only", "sub/s/only", "sub/x/y", "sub/k/x/y", "y9", "w9", "q1", "q", "q12", "[open", "n.tmp", "n.tmp/f", "é.log", "d/é/k.c",
]


def verdicts(spark, ignores, paths):
    files = spark.createDataFrame([*ignores.items(), ("null/.gitignore", None), ("other.txt", "*")], "path string, text string")
    got = G.ignored(spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "path string"), G.ignore_rules(files)).collect()
    assert len(got) == len(set(paths))
    return {r["path"]: r["ignored"] for r in got}


def git_says(tmp_path, ignores, paths):
    """Paths that git ignores; those that are folders of others are left out, git looks at the tree."""
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    folders = {"/".join(p.split("/")[:k]) for p in [*paths, *ignores] for k in range(1, p.count("/") + 1)}
    files = [p for p in paths if p not in folders]
    for p, t in [*ignores.items(), *((f, "") for f in files)]:
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_text(t, newline="")
    run = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(files).encode(), capture_output=True)
    hidden = set(run.stdout.decode().split("\0")) - {""}
    return {f: f in hidden for f in files}


def test_equal_to_git(spark, tmp_path):
    want = git_says(tmp_path, IGNORES, PATHS)
    got = verdicts(spark, IGNORES, PATHS)
    assert {p: got[p] for p in want} == want
    assert sum(want.values()) > 15 and not all(want.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_rules_equal_git(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["a", "b", "ab", "c.x", "d.x"]
    word = lambda: rng.choice([*names, "*", "a*", "*.x", "?", "**", "[ab]"])
    rule = lambda: rng.choice(["", "", "!"]) + rng.choice(["", "/"]) + "/".join(word() for _ in range(rng.choice([1, 1, 2, 3]))) + rng.choice(["", "", "/"])
    ignores = {d + ".gitignore": "\n".join(rule() for _ in range(rng.randint(1, 5))) + "\n" for d in ("", "a/", "b/a/")}
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    folders = {"/".join(p.split("/")[:k]) for p in [*paths, *ignores] for k in range(1, p.count("/") + 1)}
    paths = [p for p in paths if p not in folders]
    want = git_says(tmp_path, ignores, paths)
    got = verdicts(spark, ignores, paths)
    assert {p: got[p] for p in want} == want, ignores


def test_stronger_files_and_filter(spark):
    files = spark.createDataFrame([("a/.gitignore", "!k.py\n"), (".ignore", "k.py\n"), ("a/k.py", ""), ("a/l.py", ""), (None, "")], "path string, text string")
    rules = G.ignore_rules(files)
    assert sorted(r["path"] for r in G.without_ignored(files.where("path like '%.py'"), rules).collect()) == ["a/l.py"]
    assert G.ignored(files.where("false"), rules).count() == 0
    assert G.ignored(files, rules.where("false")).where("ignored").count() == 0


def test_scan_leaves_ignored_files_out(spark, tmp_path):
    from codestrata.sources.files import read_tree

    for p in ("a.py", "gen/b.py", "sub/c.py", "sub/d.py"):
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    ignores = spark.createDataFrame([(".gitignore", "gen/\n"), ("sub/.gitignore", "*.py\n!d.py\n")], "path string, text string")
    assert sorted(r["path"] for r in read_tree(spark, str(tmp_path), ignores=ignores).collect()) == ["a.py", "sub/d.py"]
    assert read_tree(spark, str(tmp_path)).count() == 4
