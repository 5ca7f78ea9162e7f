"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chat_format, embedding_dedup, language_model, license_scan, mixing, ngram_join, packing, prefix_trie, suffix_dedup,
               token_counts, topk_search, toxicity, turn_repair)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": lambda s, d: license_scan.op1_license_scan(table(s, d, "documents")),
    "op2_chat_format": lambda s, d: chat_format.op2_chat_format(table(s, d, "conversations")),
    "op3_topk_search": lambda s, d: topk_search.op3_topk_search(table(s, d, "embeddings")),
    "op4_ngram_jaccard": lambda s, d: ngram_join.op4_ngram_jaccard(table(s, d, "documents")),
    "op5_toxicity": lambda s, d: toxicity.op5_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op6_mixing": lambda s, d: mixing.op6_mixing(table(s, d, "documents")),
    "op7_packing": lambda s, d: packing.op7_packing(table(s, d, "documents")),
    "op8_embedding_dedup": lambda s, d: embedding_dedup.op8_embedding_dedup(table(s, d, "embeddings")),
    "op9_suffix_dedup": lambda s, d: suffix_dedup.op9_suffix_dedup(table(s, d, "documents")),
    "op10_token_counts": lambda s, d: token_counts.op10_token_counts(table(s, d, "documents")),
    "op11_lm_score": lambda s, d: language_model.op11_lm_score(table(s, d, "documents")),
    "op12_turn_repair": lambda s, d: turn_repair.op12_turn_repair(table(s, d, "conversations")),
    "op13_prefix_trie": lambda s, d: prefix_trie.op13_prefix_trie(table(s, d, "conversations")),
}

ORACLE: dict[str, str] = {
    "op1_license_scan": license_scan.SQL,
    "op2_chat_format": chat_format.SQL,
    "op3_topk_search": topk_search.SQL,
    "op6_mixing": mixing.SQL,
    "op12_turn_repair": turn_repair.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
