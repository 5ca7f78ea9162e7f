"""Benchmark definitions (A5): a JSON array of items, or an object with a
``benchmarks`` array; missing fields get the documented defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_NODE = "finance"
DEFAULT_BRIEF = "Automated deliverable brief."


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path)
    if "benchmarks" in raw.columns:
        raw = raw.select(F.explode("benchmarks").alias("b")).select("b.*")

    def col(name: str, dtype: str = "string"):
        return F.col(name) if name in raw.columns else F.lit(None).cast(dtype)

    node = F.coalesce(col("node_id"), F.lit(DEFAULT_NODE))
    return raw.select(
        F.coalesce(col("benchmark_id"), F.concat(F.lit("BENCH-"), F.upper(node))).alias("benchmark_id"),
        node.alias("node_id"),
        F.coalesce(col("brief"), F.lit(DEFAULT_BRIEF)).alias("brief"),
        col("expected_tables", "array<string>").alias("expected_tables"),
        col("expected_metrics", "array<string>").alias("expected_metrics"),
        col("target_pass_rate", "double").cast("double").alias("target_pass_rate"))
