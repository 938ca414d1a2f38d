"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op1_rp_forest
from .attention_lm import op7_attention_lm
from .exact_topk import op10_exact_topk
from .mixing import OP4_SQL, op4_temperature_mix
from .ngram_join import op6_count_vector_rtree
from .periodic_runs import op13_harmonic_runs
from .quality import op9_compression_quality
from .sentencepiece_fst import op2_sentencepiece_fst
from .sharding import op3_virtual_slots
from .token_files import op8_token_parquet
from .toxicity import op11_compression_toxicity
from .url_filter import OP5_SQL, op5_temporal_url_filter
from .whitening import op12_two_pass_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rp_forest": op1_rp_forest,
    "op2_sentencepiece_fst": op2_sentencepiece_fst,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_temperature_mix": op4_temperature_mix,
    "op5_temporal_url_filter": op5_temporal_url_filter,
    "op6_count_vector_rtree": op6_count_vector_rtree,
    "op7_attention_lm": op7_attention_lm,
    "op8_token_parquet": op8_token_parquet,
    "op9_compression_quality": op9_compression_quality,
    "op10_exact_topk": op10_exact_topk,
    "op11_compression_toxicity": op11_compression_toxicity,
    "op12_two_pass_whitening": op12_two_pass_whitening,
    "op13_harmonic_runs": op13_harmonic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op4_temperature_mix": OP4_SQL,
    "op5_temporal_url_filter": OP5_SQL,
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
}
