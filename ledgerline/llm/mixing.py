"""Mixing sources to target weights by systematic sampling (native).

Every source gets a target size: a share of the budget by weight, at most
``cap`` times its own size, the excess reshared by weight among the others.
The expected copies of a document are ``target / source_size``; their prefix
sum over the source's documents, ordered by size, plus one random offset per
source crosses an integer once per emitted copy.  Because the documents are
ordered by size, the words taken differ from the target by less than the
largest document of the source.

Defined cases: a null or empty text has size 0; a null source is a source of
its own, last in order; a source of size 0 has target 0; an empty table gives
no rows; repeated rows are documents of their own; ties in size are ordered by
the MD5 of doc_id, then by content.  Extra columns travel along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN

SIZE_CHUNK = 64  # sizes per carry block; bounds the rows of one carry window


def doc_size(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """``(source, source_size)`` -> with ``weight``, ``target`` and ``rate``.

    Sources in code point order (null last) take ``weights`` in turn.  Ordered
    by the level at which they reach their cap, the capped sources are a
    prefix, so the fixed point of the resharing is one prefix sum.  There is
    one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = (sizes.withColumn("place", F.row_number().over(by_name))
            .withColumn("weight", weight)
            .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
            .withColumn("ratio", F.col("limit") / F.col("weight"))
            .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
            .withColumn("all_weight", F.sum("weight").over(everything))
            .withColumn("spent", F.coalesce(F.sum("limit").over(below), F.lit(0.0)))
            .withColumn("gone", F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
            .withColumn("capped", F.col("ratio") <= (F.col("budget") - F.col("spent")) / (F.col("all_weight") - F.col("gone")))
            .withColumn("full", F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(everything))
            .withColumn("full_weight", F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)))
    level = (F.col("budget") - F.col("full")) / (F.col("all_weight") - F.col("full_weight"))
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", "weight", target.alias("target"),
                       F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def random_offset(source: Column, seed: str) -> Column:
    """The source's offset in [0, 1): the first 32 bits of an MD5."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
             seed: str = "mix", keep_row: bool = True) -> DataFrame:
    """One row per document: ``row`` (the whole input row, if ``keep_row``),
    ``doc_id, source, size, source_size, target, copies``.

    The rank of a document in its source is the count of the documents before
    its (size, salt) cell plus its place in the cell; cell counts are summed
    up in two levels, so neither a hot source nor a hot size meets in one
    task, and the texts are shuffled once."""
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(*([F.struct("*").alias("row")] if keep_row else []), "doc_id", "source",
                       doc_size(F.col("text")).alias("size"), tie.alias("tie"),
                       *([F.xxhash64(*docs.columns).alias("content")] if keep_row else [F.lit(0).alias("content")]))
    rows = (rows.withColumn("chunk", F.floor(F.col("size") / SIZE_CHUNK))
            .withColumn("salt", F.substring("tie", 1, 1)))
    cells = rows.groupBy("source", "chunk", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    chunks = cells.groupBy("source", "chunk").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    sizes = chunks.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).withColumn("u", random_offset(F.col("source"), seed))
    over_chunks = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    in_chunk = Window.partitionBy("source", "chunk").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("source", "chunk", F.coalesce(F.sum("n").over(over_chunks), F.lit(0)).alias("before"))
    carry = (_join_null_safe(_join_null_safe(
        cells.withColumn("inner", F.coalesce(F.sum("n").over(in_chunk), F.lit(0))).drop("n"),
        before, ["source", "chunk"]), targets, ["source"])
        .withColumn("before", F.col("before") + F.col("inner")).drop("inner", "weight"))
    cell = Window.partitionBy("source", "chunk", "size", "salt").orderBy("tie", "content")
    placed = _join_null_safe(rows.withColumn("place", F.row_number().over(cell)), carry,
                             ["source", "chunk", "size", "salt"])
    place = (F.col("before") + F.col("place")).cast("double")
    upto = F.floor(F.col("rate") * place + F.col("u"))
    since = F.floor(F.col("rate") * (place - F.lit(1.0)) + F.col("u"))
    copies = F.least(upto - since, F.lit(int(cap))).cast("long")
    return placed.select(*(["row"] if keep_row else []), "doc_id", "source", "size", "source_size", "target",
                         copies.alias("copies"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where only ``source`` may be null."""
    right = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) if k == "source" else F.col(k) == F.col(f"__{k}") for k in keys]
    return left.join(right, on).drop(*[f"__{k}" for k in keys])


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the
    input's columns."""
    plan = mix_plan(docs, **settings).filter("copies > 0")
    return plan.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


# --- query ---------------------------------------------------------------

def op6_mixing(docs: DataFrame) -> DataFrame:
    return mix_plan(docs, keep_row=False).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((place - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size::DOUBLE AS lim FROM s),
r AS (
  SELECT *, lim / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, sum(weight) OVER () AS all_weight FROM w),
c AS (
  SELECT *, coalesce(sum(lim) OVER b, 0.0::DOUBLE) AS spent, coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS gone FROM r
  WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, ratio <= (budget - spent) / (all_weight - gone) AS capped FROM c),
f AS (
  SELECT *, sum(CASE WHEN capped THEN lim ELSE 0 END) OVER () AS full_size,
         sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS full_weight FROM k),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN lim ELSE weight * ((budget - full_size) / (all_weight - full_weight)) END AS target,
         ('0x' || substr(md5('mix' || coalesce('s' || source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')))::DOUBLE AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * least(floor(rate * place + u) - floor(rate * (place - 1.0::DOUBLE) + u), 2)::BIGINT AS taken FROM p
"""
