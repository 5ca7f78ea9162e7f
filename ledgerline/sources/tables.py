"""Spark access to the driver tables and the adapter (domain) tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import running, slice_of
from .adapters import ADAPTERS, DRIVER_TABLES, SPARK, adapter_sql, dependencies


def _numbered_traces(traces: DataFrame) -> DataFrame:
    t = traces.select("event_id", "loop_id", "node_id", "step_name", "ts").withColumn("slice", slice_of("ts"))
    return running(t, ["loop_id"], "slice", ["ts", "event_id"], F.lit(1), "seq").drop("slice")


# Adapter tables whose ordered numbering Spark computes in slices of the key.
SLICED = {"numbered_traces": ("session_traces", _numbered_traces)}


# Parquet schemas of the driver files, read once per process (schema
# inference opens a file footer; the files are read-only inputs).
_SCHEMAS: dict[str, object] = {}


class Tables:
    """Lazy loader: ``t.orders`` (driver parquet) or ``t.invoices`` (adapter).

    Frames are memoised per instance so one query plan reuses one scan node
    per table; nothing is cached in Spark memory.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        path = os.path.join(self.sf_dir, f"{name}.parquet")
        schema = _SCHEMAS.get(path)
        if schema is None:
            df = self.spark.read.parquet(path)
            _SCHEMAS[path] = df.schema
            return df
        return self.spark.read.schema(schema).parquet(path)

    def get(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in DRIVER_TABLES:
                df = self.raw(name)
            elif name in SLICED:
                source, build = SLICED[name]
                df = build(self.get(source))
            elif name in ADAPTERS:
                deps = {dep: self.get(dep) for dep in dependencies(name)}
                df = self.spark.sql(adapter_sql(name, SPARK), **deps)
            else:
                raise KeyError(f"unknown table {name!r}")
            self._frames[name] = df
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.get(name)
        except KeyError as exc:
            raise AttributeError(name) from exc
