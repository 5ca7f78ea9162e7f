"""Structured Streaming forms of the telemetry pipelines.

Sources are file streams over the driver's parquet files.

* J1 appends every event to a Parquet table.
* J2 counts errors per hour in keyed state behind a watermark: a window is
  written once, when no row for it is awaited any more; rows that arrive for a
  closed window are dropped and counted (``late_rows``).
* J3 keeps the first resolution of each (loop, gate) in keyed state that
  expires by event time, so its size is bounded by the gates of one period.
* J4 keeps the newest row per loop in state and rewrites only the key buckets
  that a micro-batch touches, as a version of a committed table
  (``sources.commits``) that names the micro-batch: a replay changes nothing.

State is kept in RocksDB (``use_rocksdb``) unless the session names another
store.  Every stream keeps its progress and output under the session's shared
``spark.checkpoint.dir``.  ``start_*`` returns the running query (the caller
waits, stops or schedules it); the registered ``stream_*`` forms run the stream
over all data present and read the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timeutil import epoch_micros, instant_to_ntz, ntz_to_instant
from ..session import checkpoint_dir
from ..sources.adapters import SPARK, adapter_sql
from ..sources.commits import CommitLog, read_committed

ERROR_LATENESS_HOURS = 2  # an error window closes this long after its end


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, source: str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of the events files: by default the driver's events
    file (a one-file glob, so the folder's other tables are not picked up),
    or any folder/glob of event parquet files (``source``).
    ``files_per_trigger`` only paces a backlog; it never changes a result."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source or f"{sf_dir}/events.parque[t]")


def traces_of(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(adapter_sql("session_traces", SPARK), events=events)


def errors_of(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(adapter_sql("error_logs", SPARK), events=events)


def gates_of(events: DataFrame) -> DataFrame:
    log = events.sparkSession.sql(adapter_sql("loop_events", SPARK), session_traces=traces_of(events))
    return log.filter(F.col("decision").isNotNull())


def _finished(query: StreamingQuery) -> None:
    query.awaitTermination()


# J1
def start_traces(spark: SparkSession, sf_dir: str, out: str, source: str | None = None,
                 files_per_trigger: int | None = None) -> StreamingQuery:
    """Ingest telemetry events and append them to a Parquet table."""
    return (traces_of(event_stream(spark, sf_dir, source, files_per_trigger)).writeStream.format("parquet")
            .outputMode("append").option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/data")
            .trigger(availableNow=True).start())


def stream_traces(spark: SparkSession, sf_dir: str, out: str | None = None, source: str | None = None,
                  files_per_trigger: int | None = None) -> DataFrame:
    out = out or _scratch(spark, "traces")
    _finished(start_traces(spark, sf_dir, out, source, files_per_trigger))
    return spark.read.parquet(f"{out}/data")


# State ------------------------------------------------------------------------
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks instead of their heaps, with changelogs
    as checkpoints; a store that the session names stays."""
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators dropped for being older than
    the watermark, over the progress that Spark retains
    (``spark.sql.streaming.numRecentProgressUpdates``).  An aggregation sees
    them after its map-side part: late rows of one key and task count once."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


# J2
def hourly_error_windows(errors: DataFrame, lateness_hours: int = ERROR_LATENESS_HOURS) -> DataFrame:
    """Errors per hour and severity behind a watermark (which needs instants:
    the zone-less wall clock is read as UTC and given back as such)."""
    return (errors.select(ntz_to_instant("log_timestamp").alias("at"), "severity").withWatermark("at", f"{lateness_hours} hours")
            .groupBy(F.window("at", "1 hour").alias("w"), "severity").agg(F.count(F.lit(1)).alias("errors"))
            .select(instant_to_ntz(F.col("w.start")).alias("window_start"), instant_to_ntz(F.col("w.end")).alias("window_end"),
                    "severity", "errors"))


def start_hourly_errors(spark: SparkSession, sf_dir: str, out: str, source: str | None = None,
                        files_per_trigger: int | None = None) -> StreamingQuery:
    """Closed windows are appended to a Parquet table, each once."""
    use_rocksdb(spark)
    windows = hourly_error_windows(errors_of(event_stream(spark, sf_dir, source, files_per_trigger)))
    return (windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/_checkpoint")
            .option("path", f"{out}/data").trigger(availableNow=True).start())


def stream_hourly_errors(spark: SparkSession, sf_dir: str, out: str | None = None, source: str | None = None,
                         files_per_trigger: int | None = None) -> DataFrame:
    """Tumbling 1 h error counts per severity of the windows that ended at
    least two hours before the newest error."""
    out = out or _scratch(spark, "hourly_errors")
    _finished(start_hourly_errors(spark, sf_dir, out, source, files_per_trigger))
    return spark.read.schema("window_start timestamp_ntz, window_end timestamp_ntz, severity string, errors bigint").parquet(f"{out}/data")


# J3
GATE_LATENESS = "2 days"  # a resolution may arrive that late
GATE_REPEAT_DAYS = 365  # a gate resolved again within that time is a conflict
_GATE_ROW = "loop_id string, gate string, decision string, event_id bigint, us bigint"


def first_gates(resolutions: DataFrame, lateness: str = GATE_LATENESS, repeat_days: int = GATE_REPEAT_DAYS) -> DataFrame:
    """The first resolution (event time, then event id) per loop and gate.

    Spark's ``dropDuplicatesWithinWatermark`` keeps whichever row of a
    micro-batch its task reads first; here the rows of a key are put in order,
    so that resolutions that arrive together are decided by event time too."""
    keep_ms, columns = repeat_days * 86_400_000, ["loop_id", "gate", "decision", "event_id", "us"]

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for rows in batches:
            row = rows.sort_values(["us", "event_id"]).iloc[:1]
            best = row if best is None else pd.concat([best, row]).sort_values(["us", "event_id"]).iloc[:1]
        if best is not None and not state.exists:
            state.update((int(best["event_id"].iloc[0]),))
            state.setTimeoutTimestamp(max(int(best["us"].iloc[0]) // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
            yield best[columns]

    rows = resolutions.select("loop_id", "gate", "decision", "event_id", epoch_micros("ts").alias("us"), ntz_to_instant("ts").alias("at"))
    found = (rows.withWatermark("at", lateness).groupBy("loop_id", "gate")
             .applyInPandasWithState(first, _GATE_ROW, "event_id bigint", "append", GroupStateTimeout.EventTimeTimeout))
    return found.select("loop_id", "gate", "decision", "event_id", instant_to_ntz(F.timestamp_micros("us")).alias("ts"))


def start_gate_dedup(spark: SparkSession, sf_dir: str, out: str, source: str | None = None,
                     files_per_trigger: int | None = None, repeat_days: int = GATE_REPEAT_DAYS) -> StreamingQuery:
    use_rocksdb(spark)
    rows = (gates_of(event_stream(spark, sf_dir, source, files_per_trigger))
            .select("loop_id", F.col("step_name").alias("gate"), "decision", "event_id", "ts"))
    return (first_gates(rows, repeat_days=repeat_days).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/data").trigger(availableNow=True).start())


def stream_gate_dedup(spark: SparkSession, sf_dir: str, out: str | None = None, source: str | None = None,
                      files_per_trigger: int | None = None) -> DataFrame:
    """The effective resolution of every (loop, gate), as the EFFECTIVE rows
    of I4 for events that arrive in time."""
    out = out or _scratch(spark, "gate_dedup")
    _finished(start_gate_dedup(spark, sf_dir, out, source, files_per_trigger))
    return spark.read.schema("loop_id string, gate string, decision string, event_id bigint, ts timestamp_ntz").parquet(f"{out}/data")


# J4
STATE_BUCKETS = 32  # key buckets of the state table: a micro-batch rewrites those it touches
_STATE_ROW = "loop_id string, current_step string, updated_at timestamp_ntz, event_id bigint"


def latest_states(rows: DataFrame) -> DataFrame:
    """Newest row (event time, then event id) per loop."""
    newest = F.max_by(F.struct("current_step", "updated_at", "event_id"), F.struct("updated_at", "event_id"))
    return rows.groupBy("loop_id").agg(newest.alias("s")).select("loop_id", "s.*")


def _bucket_of(folder: str) -> int:
    return int(folder.rsplit("bucket=", 1)[1])


def upsert_states(batch: DataFrame, epoch: int, table: str, buckets: int = STATE_BUCKETS) -> None:
    """Merge a micro-batch into the state table at ``table``: the buckets of
    its keys are rewritten, the others stay.  The version names the
    micro-batch; one that is already in the table is not written again."""
    spark = batch.sparkSession
    log = CommitLog(spark, table)
    version = log.latest()
    if version and epoch <= log.manifest(version)["note"]["epoch"]:
        return
    batch = batch.withColumn("bucket", F.pmod(F.xxhash64("loop_id"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = {r.bucket for r in batch.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        old = [f for f in log.live(version) if _bucket_of(f) in touched]
        rows = batch.drop("bucket")
        if old:
            rows = rows.unionByName(log.frame(old).select(*rows.columns))
        merged = latest_states(rows).withColumn("bucket", F.pmod(F.xxhash64("loop_id"), F.lit(buckets)).cast("int"))
        folder = log.stage(merged.repartition("bucket"), ["bucket"])
        if not log.commit(version + 1, [f"{folder}/bucket={b}" for b in sorted(touched)], old, {"epoch": epoch}):
            raise RuntimeError(f"{table} has another writer")
    finally:
        batch.unpersist()


def start_latest_state(spark: SparkSession, sf_dir: str, out: str, source: str | None = None,
                       files_per_trigger: int | None = None) -> StreamingQuery:
    use_rocksdb(spark)
    rows = traces_of(event_stream(spark, sf_dir, source, files_per_trigger)).select(
        "loop_id", F.col("step_name").alias("current_step"), F.col("ts").alias("updated_at"), "event_id")
    return (latest_states(rows).writeStream.outputMode("update")
            .foreachBatch(lambda batch, epoch: upsert_states(batch, epoch, f"{out}/table"))
            .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())


def stream_latest_state(spark: SparkSession, sf_dir: str, out: str | None = None, source: str | None = None,
                        files_per_trigger: int | None = None) -> DataFrame:
    """Current step per loop."""
    out = out or _scratch(spark, "latest_state")
    _finished(start_latest_state(spark, sf_dir, out, source, files_per_trigger))
    schema = T._parse_datatype_string(_STATE_ROW)
    return read_committed(spark, f"{out}/table", schema=schema).select("loop_id", "current_step", "updated_at")
