import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from codestrata.llm import mixing, quality, registry, sentencepiece_fst
from codestrata.llm.ngram_join import one_of_each
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLE_SQL[name]) > 0


def test_pipeline_matches_brute_force(spark):
    from .test_texts import components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    kept = [r for r, s in zip(rows, model.score([(r["text"] or "").encode() for r in rows]), strict=True) if s >= quality.THRESHOLD]
    kept = [r for r, (i, n, c) in zip(kept, components(kept), strict=True) if i == c]
    assert 0 < len(kept) < len(rows)
    con = connect(SF)
    ids = ",".join(str(r["doc_id"]) for r in kept)
    con.execute(f"create or replace temp view documents as select * from read_parquet('{SF}/documents.parquet') where doc_id in ({ids})")
    times = Counter(r[0] for r in con.sql(f"select doc_id from ({mixing.OP4_SQL})").fetchall())
    own = sentencepiece_fst.transducer()
    want = Counter()
    for r in kept:
        want[(r["doc_id"], tuple(own.encode(r["text"] or "").tolist()))] += times[r["doc_id"]]
    assert Counter((r["doc_id"], tuple(r["piece_ids"])) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_keep_columns(spark, nothing, dirty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, dirty, SF).columns == dirty.columns
        assert stage(spark, nothing, SF).count() == 0


def test_one_of_each_by_rows(spark):
    """Null ids and repeated ids: one row of each group stays, and all rows without words."""
    from .conftest import sentence

    rng = random.Random(9)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    rows = [(5, a), (5, a), (5, a + " "), (None, a), (3, b), (5, b), (None, c), (None, d), (None, d), (None, ""), (None, None), (9, ""), (9, "")]
    got = one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
    want = [(5, a), (3, b), (None, c), (None, d), (None, ""), (None, ""), (9, ""), (9, "")]
    assert Counter((r["doc_id"], (r["text"] or "").strip()) for r in got) == Counter(want)
