"""Tables dealt by key in as many parts as their rows ask for: same results, and tasks that do not grow with the table."""

from collections import Counter

from codestrata.config import CoChangeConfig
from codestrata.operators import api, cochange, dealing
from codestrata.sources import diffs


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "PART_ROWS", 100)
    assert dealing.parts(spark.range(1000)) == 11 and dealing.parts(spark.range(0)) == 1
    assert dealing.deal(spark.range(10), 7, "id").rdd.getNumPartitions() == 7


def test_cochange_counts_a_unit_once_over_its_commits(spark):
    files = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "b"), ("3", "c"), ("4", "a")], "sha string, path string")
    evidence = spark.createDataFrame([("a", "1", "m", 0), ("a", "2", "m", 60), ("a", "3", None, 0), ("a", "4", "n", 0), ("a", "5", "n", 0)], "source string, sha string, author_mail string, author_time long")
    for parts in (None, 3):
        got = cochange.candidates(evidence, files, CoChangeConfig(), parts=parts)
        assert rows(got.select("candidate", "co", "den", "units", "co_units", "total_changes_a", "total_changes_b")) == {("b", 3, 5, 2, 1, 5, 3): 1, ("c", 1, 5, 2, 0, 5, 1): 1}


def test_evidence_is_chosen_in_parts(spark):
    touches = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", "3", 3), ("b", "1", 1)], "path string, sha string, ord int")
    assert rows(cochange.history(touches, 2, 3).select("path", "sha")) == {("a", "3"): 1, ("a", "2"): 1, ("b", "1"): 1}
    blame = spark.createDataFrame([("a", "9"), ("c", "8"), ("c", "8")], "source string, sha string")
    assert rows(cochange.choose_evidence(blame, touches.selectExpr("path as source", "sha"), 2, 3).select("source", "mode")) == {("a", "history"): 3, ("b", "history"): 1, ("c", "blame"): 1}


def test_members_and_uses_are_dealt_once(spark):
    members = spark.createDataFrame([("A", "m"), ("A", "m"), (None, "m"), ("A", None), ("B", "n")], "owner string, name string")
    uses = spark.createDataFrame([("A", "m", False), (None, "m", False), ("B", "n", True), ("C", "n", False), ("A", None, False)], "receiver string, name string, is_test boolean")
    got = api.member_liveness(members, uses, 3)
    assert str(got._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    assert rows(got) == {("A", "m", 1, 0, "live"): 2, (None, "m", 0, 0, "ambiguous"): 1, ("A", None, 0, 0, "dead"): 1, ("B", "n", 0, 1, "test-only"): 1}


def test_lines_of_a_common_name_are_not_shuffled_by_it(spark):
    lines = spark.createDataFrame([("d", "f", 1, 1, "-", "fn go(a)"), ("d", "f", 1, 2, "+", "fn go(b)")], "diff_id string, new_path string, hunk int, ord int, tag string, text string")
    got = diffs.signature_changes(lines, spark.createDataFrame([("go",)], "name string"))
    assert rows(got) == {("d", "f", "go", "fn go(a)", "fn go(b)"): 1}
    assert "BroadcastHashJoin" in str(got._jdf.queryExecution().executedPlan())
