"""Stages of the corpus pipeline over the operators of this folder.

Every stage keeps the input's columns (the last one aside) and handles an
empty table, null texts and columns it does not know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, ngram_join, packing, suffix_dedup, toxicity
from .common import table, workers_import


# Bytes of the strings that the suffix_dedup stage removes.  A passage of 50
# words is some 280 bytes or more (the least of those that repeat in the given
# tables has 285); the window lies below that, so that all of its bytes are
# covered, and well above a common sentence.
STAGE_WINDOW = 256


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, as learned from the
    labels of ``sf_dir``."""
    workers_import(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.75."""
    workers_import(spark)
    return ngram_join.keep_one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages (``STAGE_WINDOW`` bytes or
    more) that start at several places.
    A character cut in two goes as a whole; null texts stay null; ``n_chars``
    follows the text if the table has it."""
    workers_import(spark)
    cut = suffix_dedup.without_repeats(docs, window=STAGE_WINDOW, whole_characters=True)
    left = F.when(F.col("had_text"), F.col("kept").cast("string"))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(left.alias("text"))
        elif name == "n_chars":
            out.append(F.when(F.col("n_removed") == 0, F.col("row.n_chars"))
                       .otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col("row").getField(name).alias(name))
    return cut.select(*out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, repeats as rows of their own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in a sequence."""
    workers_import(spark)
    return packing.pack(packing.token_pieces(docs))
