"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, kd_shards, language, near_dups, pieces, pseudo_lm, quality, suffix_dedup, token_counts, topk
from .scratch import small_batches


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(small_batches(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_decontamination": decontaminate.op1_suffix_decontamination,
    "op2_segment_topk": topk.op2_segment_topk,
    "op3_kd_tree_sharding": kd_shards.op3_kd_tree_sharding,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_piece_encoding": pieces.op6_piece_encoding,
    "op7_masked_pseudo_likelihood": pseudo_lm.op7_masked_pseudo_likelihood,
    "op8_language_fusion": language.op8_language_fusion,
    "op9_bagminhash_near_dedup": near_dups.op9_bagminhash_near_dedup,
    "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
}
QUERIES = {name: _prepared(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_decontamination": decontaminate.OP1_SQL,
    "op2_segment_topk": topk.OP2_SQL,
    "op10_suffix_array_dedup": suffix_dedup.OP10_SQL,
}
