"""Corpus pipeline: documents -> packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before kept; its result is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import stages
from ledgerline.llm.common import table, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard", stages.drop_near_copies),
    ("suffix_dedup", stages.cut_repeats),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

# The classifier, the similarity groups and the suffix arrays have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
