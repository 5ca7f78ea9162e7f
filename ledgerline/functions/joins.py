"""Join helpers: which joins may force a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_fixed(df: DataFrame) -> DataFrame:
    """Broadcast a table whose size is fixed by construction (rule tables).
    Every other join is left to the planner and AQE, which go by size."""
    return F.broadcast(df)
