"""The corpus pipeline: quality classifier, near-duplicate removal, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first drops what the
classifier rejects, the second keeps the smallest doc_id of each near-duplicate group, the third repeats
documents of small sources and leaves none out, the last gives each row its piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm.common import scratch_path
from codestrata.llm.mixing import mixed
from codestrata.llm.ngram_join import one_of_each
from codestrata.llm.quality import keep_good
from codestrata.llm.sentencepiece_fst import encoded_rows

STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding", encoded_rows),
]

#: SQL expresses neither the classifier nor the encoder; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
