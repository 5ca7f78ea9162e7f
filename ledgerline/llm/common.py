"""Shared helpers: table access, written intermediates, connected components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# White space of every word operator: space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 1000  # whole documents in an Arrow batch
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (as with any package, a cluster installs it or gets it by --py-files).  So
    that workers stay small between stages, Arrow batches of whole documents
    are short, unless the session sets its own size, and the workers' C
    library gives large freed arrays back at once."""
    if int(spark.conf.get(_BATCH)) == 10_000:  # Spark's default
        spark.conf.set(_BATCH, BATCH_ROWS)
    for name, size in (("MALLOC_MMAP_THRESHOLD_", 4 << 20), ("MALLOC_TRIM_THRESHOLD_", 8 << 20)):
        spark.sparkContext.environment.setdefault(name, str(size))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read
    it back.  A lost executor then costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number of hash blocks."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(*cols: str | Column) -> list[Column]:
    """128-bit content key of a row as two longs.  Unlike a generated row id
    it is the same in every job, also after an executor was lost."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty.  Native: the words
    are squeezed to one character each."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_PATTERN, "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Component label (smallest node) of every node of the undirected
    ``edges(a, b)``: ``(node, label)``.

    Each round hooks the parents of an edge's ends to the smaller
    grandparent and then halves the paths, so the number of rounds grows with
    the logarithm of a component's size.  All steps are joins and grouped
    minima with map-side combine: a hub of any degree never meets in one
    task, and nothing is collected.  The labels are written each round; the
    loop ends when no label moved."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both = written(both, f"{name}-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")),
                     f"{name}-labels")
    while True:
        up = labels.select(F.col("node").alias("p"), F.col("label").alias("gp"))
        grand = labels.join(up, labels["label"] == up["p"]).select("node", "label", "gp")
        near = (both.join(grand.select(F.col("node").alias("v"), F.col("gp").alias("gv")), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("gv").alias("gv")))
        seen = grand.join(near, "node").withColumn("best", F.least("gv", "gp"))
        hooks = (seen.select("node", "best")
                 .unionByName(seen.select(F.col("label").alias("node"), "best"))
                 .groupBy("node").agg(F.min("best").alias("best")))
        moved = (grand.join(hooks, "node")
                 .select("node", F.least("best", "gp").alias("label"), (F.least("best", "gp") < F.col("label")).alias("moved")))
        step = written(moved, f"{name}-step")
        labels = step.select("node", "label")
        if step.filter("moved").limit(1).count() == 0:
            return labels


def salted_rank(df: DataFrame, keys: list[str], order: list[str], salt: Column, buckets: int | None = 64) -> DataFrame:
    """Add ``rank`` (1..n) of each row within ``keys``, in the order of
    (salt bucket, order).  Rows of a hot key are ranked in ``buckets`` tasks;
    the carry between buckets comes from one row per (keys, bucket).  Without
    ``buckets`` the salt itself is the bucket (a range of the order).  Keys
    may be null."""
    src = df.withColumn("__b", salt if buckets is None else F.pmod(salt, F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (src.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
             .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
             .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__cb"), "__before"))
    ranked = src.withColumn("__in", F.row_number().over(inside))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__b") == F.col("__cb")]
    return (ranked.join(carry, on)
            .withColumn("rank", (F.col("__in") + F.col("__before")).cast("long"))
            .drop("__b", "__in", "__cb", "__before", *[f"__k{i}" for i in range(len(keys))]))
