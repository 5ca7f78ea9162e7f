"""Exact top-k inner product search with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its deviation (the
norm of what is left after the mean).  For a query q and a candidate x,

    q.x = sum over segments of  n * mean(q) * mean(x) + rest(q).rest(x)

and rest(q).rest(x) is at most deviation(q) * deviation(x), so the statistics
bound the score from above (equivalently, with |q|^2 + |x|^2 - 2 q.x, the
distance from below).  From few segments to many the bound tightens; a pair
whose bound falls under the query's k-th best score so far is dropped, and the
exact score is computed for the survivors only.

Queries travel in blocks of ``QUERIES`` rows to blocks of ``VECTORS``
candidates; each block pair returns at most k rows a query, of which the best
k are kept.  The k-th best scores of a first pass over one block per query
block start the pruning.

Components are integers ``floor(scale * x)``, x as double; scores are exact
integers, ties go to the smaller vec_id.

Defined cases: a vector that is null or empty, or holds null or non-finite
components, takes no part; vectors of another length than the query's are no
candidates; repeated rows are candidates of their own, and a query's own row
is every row with its vec_id; a null vec_id takes no part; fewer than k
candidates are all returned; an empty table gives no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TOP = 5
EVERY = 50
SCALE = 256
LEVELS = (1, 4, 16)  # segments, coarse to fine
QUERIES = 1024  # queries of a block
VECTORS = 4096  # candidates of a block


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, vec (array<long>), dim`` of the rows that take part."""
    finite = F.expr("forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return (rows.filter("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0").filter(finite)
            .select("vec_id", F.expr(f"transform(x, v -> cast(floor(double({scale}) * v) AS bigint))").alias("vec"),
                    F.size("x").alias("dim")))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows -> one row per block: ids and vectors as lists, in blocks of
    about ``size`` rows dealt by a hash of the id."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return rows.join(counts, "dim").withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(f"{name}s")).cast("int"))


def _statistics(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of ``matrix`` from above: scaled
    segment means, then segment deviations."""
    parts = np.array_split(np.arange(matrix.shape[1]), min(segments, matrix.shape[1]))
    mean = np.stack([matrix[:, p].mean(axis=1) * np.sqrt(len(p)) for p in parts], axis=1)
    power = np.stack([(matrix[:, p] ** 2).sum(axis=1) for p in parts], axis=1)
    return np.concatenate([mean, np.sqrt(np.maximum(power - mean ** 2, 0))], axis=1)


def _best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best candidates of each query."""
    order = np.lexsort((vec_id, -score, query))
    query = query[order]
    first = np.searchsorted(query, query, "left")
    return order[np.arange(len(query)) - first < top]


def _search(top: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group[group["floor"].notna()].sort_values("vec_id")
        rows = group[group["floor"].isna()].sort_values("vec_id")
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(asks) and len(rows):
            q = np.stack(asks["vec"].to_list()).astype(np.float64)
            x = np.stack(rows["vec"].to_list()).astype(np.float64)
            ids, q_ids, floor = rows["vec_id"].to_numpy(), asks["vec_id"].to_numpy(), asks["floor"].to_numpy()
            alive = np.ones((len(q), len(x)), bool)
            for segments in LEVELS:
                bound = _statistics(q, segments) @ _statistics(x, segments).T
                alive &= bound * (1 + 1e-9) + 1e-3 >= floor[:, None]
            ask, row = np.nonzero(alive)
            other = q_ids[ask] != ids[row]
            ask, row = ask[other], row[other]
            score = np.zeros(len(ask), np.int64)
            qi, xi = q.astype(np.int64), x.astype(np.int64)
            for low in range(0, len(ask), 1 << 16):
                part = slice(low, low + (1 << 16))
                score[part] = np.einsum("ij,ij->i", qi[ask[part]], xi[row[part]])
            best = _best(ask, score, ids[row], top)
            out = {"query_id": q_ids[ask[best]], "vec_id": ids[row[best]], "score": score[best]}
        return pd.DataFrame(out).astype("int64")

    return run


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows of ``vectors`` with
    the largest inner products for each row of ``queries`` (both as from
    :func:`quantised`, ids of queries distinct)."""
    rows = written(_blocks(vectors, VECTORS, "row_block"), "search-rows")
    asks = written(_blocks(queries.dropDuplicates(["vec_id"]), QUERIES, "ask_block"), "search-asks")
    counts = rows.groupBy("dim").agg(F.max("row_blocks").alias("row_blocks"))
    ask_counts = asks.groupBy("dim").agg(F.max("ask_blocks").alias("ask_blocks"))
    columns = ["dim", "ask_block", "row_block", "vec_id", "vec", "floor"]
    nothing = F.lit(None).cast("double")

    def search(ask_rows: DataFrame, row_rows: DataFrame) -> DataFrame:
        both = ask_rows.select(*columns).unionByName(row_rows.select(*columns))
        return (both.groupBy("dim", "ask_block", "row_block")
                .applyInPandas(_search(top), "query_id long, vec_id long, score long"))

    # First pass: a query block meets one row block, which gives each query a
    # floor, the score its k-th best candidate reaches there.
    low = F.lit(float("-inf"))
    seed_block = F.pmod("ask_block", F.col("row_blocks")).cast("int")
    seed_asks = asks.join(counts, "dim").withColumn("row_block", seed_block).withColumn("floor", low)
    seed_rows = (rows.join(ask_counts, "dim")
                 .withColumn("ask_block", F.explode(F.filter(F.sequence(F.lit(0), F.col("ask_blocks") - 1),
                                                             lambda b: F.pmod(b, F.col("row_blocks")) == F.col("row_block"))))
                 .withColumn("floor", nothing))
    seeds = written(_top(search(seed_asks, seed_rows), top), "search-seeds")
    floors = seeds.filter(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    # Second pass: every query block meets every other row block.
    all_asks = (asks.join(floors, "vec_id", "left").join(counts, "dim")
                .withColumn("floor", F.coalesce("floor", low))
                .withColumn("row_block", F.explode(F.filter(F.sequence(F.lit(0), F.col("row_blocks") - 1),
                                                            lambda b: b != F.pmod("ask_block", F.col("row_blocks"))))))
    all_rows = (rows.join(ask_counts, "dim")
                .withColumn("ask_block", F.explode(F.filter(F.sequence(F.lit(0), F.col("ask_blocks") - 1),
                                                            lambda b: F.pmod(b, F.col("row_blocks")) != F.col("row_block"))))
                .withColumn("floor", nothing))
    found = seeds.select("query_id", "vec_id", "score").unionByName(search(all_asks, all_rows))
    return _top(found, top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# --- query ---------------------------------------------------------------

def op3_topk_search(vectors: DataFrame) -> DataFrame:
    rows = quantised(vectors)
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id != q.vec_id AND len(c.vec) = len(q.vec) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
