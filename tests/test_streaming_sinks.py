"""Streaming == batch; sinks and readers."""
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import lifecycle as L
from ledgerline.sources import sinks
from ledgerline.sources.benchmarks import read_benchmarks
from ledgerline.sources.commits import CommitLog, read_committed
from ledgerline.streaming import streams as J
from paths import SF_SMALL


def test_stream_traces_equal_batch(spark, small):
    got = J.stream_traces(spark, SF_SMALL)
    assert got.exceptAll(small.session_traces).count() == 0
    assert small.session_traces.exceptAll(got).count() == 0


def test_stream_hourly_errors_closed_windows_equal_batch(spark, small):
    got = {(r.window_start, r.severity): r.errors for r in J.stream_hourly_errors(spark, SF_SMALL).collect()}
    err = small.error_logs
    max_ts = err.agg(F.max("log_timestamp")).first()[0]
    b = (err.withColumn("w", F.date_trunc("hour", "log_timestamp")).groupBy("w", "severity").count().collect())
    from datetime import timedelta
    exp = {(r.w, r.severity): r["count"] for r in b if r.w + timedelta(hours=1) <= max_ts - timedelta(hours=2)}
    assert got == exp and got


def test_stream_latest_state_and_gate_dedup(spark, small):
    latest = {r.loop_id: r.current_step for r in J.stream_latest_state(spark, SF_SMALL).collect()}
    tr = small.session_traces
    exp = {r.loop_id: r.s for r in tr.groupBy("loop_id").agg(
        F.max_by("step_name", F.struct("ts", "event_id")).alias("s")).collect()}
    assert latest == exp
    dedup = J.stream_gate_dedup(spark, SF_SMALL)
    keys = small.loop_events.filter(F.col("decision").isNotNull()).select("loop_id", "step_name").distinct().count()
    assert dedup.count() == keys


def test_partitioned_write_and_sealed_audit(spark, small, scratch):
    path = os.path.join(scratch, "invoices")
    sinks.write_invoices(small.invoices, path)
    back = read_committed(spark, path)
    assert back.count() == small.invoices.count()
    [folder] = CommitLog(spark, path).live()
    months = [m for m in os.listdir(os.path.join(path, folder)) if m.startswith("issue_date_month=")]
    assert len(months) == small.invoices.select(F.date_format("issue_date", "yyyy-MM")).distinct().count()
    sinks.write_invoices(small.invoices.limit(3), path, replace=True)
    assert read_committed(spark, path).count() == 3 and read_committed(spark, path, 1).count() == back.count()
    audit = os.path.join(scratch, "audit")
    first = spark.createDataFrame([("k1", "a"), ("k2", "b")], "object_key string, v string")
    sinks.append_audit(spark, first, audit)
    second = spark.createDataFrame([("k2", "CHANGED"), ("k3", "c")], "object_key string, v string")
    sinks.append_audit(spark, second, audit)
    got = {r.object_key: r.v for r in read_committed(spark, audit).collect()}
    assert got == {"k1": "a", "k2": "b", "k3": "c"}


def test_publish_view(spark, small):
    name = sinks.publish_view(small.invoices, "finance", {"finance": "weekly_revenue_variance"})
    assert name == "weekly_revenue_variance" and spark.table(name).count() == small.invoices.count()
    assert sinks.publish_view(small.invoices) == "primary_view"


def test_read_benchmarks(spark, scratch):
    a = os.path.join(scratch, "a.json")
    with open(a, "w") as f:
        json.dump([{"benchmark_id": "B1", "node_id": "sales", "brief": "x"}, {"brief": "y"}], f)
    b = os.path.join(scratch, "b.json")
    with open(b, "w") as f:
        json.dump({"benchmarks": [{"node_id": "firmware"}]}, f)
    ra = {r.benchmark_id: (r.node_id, r.brief) for r in read_benchmarks(spark, a).collect()}
    assert ra == {"B1": ("sales", "x"), "BENCH-FINANCE": ("finance", "y")}
    rb = read_benchmarks(spark, b).first()
    assert (rb.benchmark_id, rb.brief) == ("BENCH-FIRMWARE", "Automated deliverable brief.")


def test_stream_latest_state_resumes_from_checkpoint(spark, small, scratch):
    """Stop after half the events, add the rest, restart from the same
    checkpoint: the snapshot equals the batch answer (no loss, no repeat)."""
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    src = os.path.join(scratch, "events_in")
    ev.filter(F.col("event_id") % 2 == 0).coalesce(1).write.parquet(os.path.join(src, "part_a"))
    out = os.path.join(scratch, "latest")
    J.stream_latest_state(spark, SF_SMALL, out=out, source=os.path.join(src, "*", "*.parquet"))
    ev.filter(F.col("event_id") % 2 == 1).coalesce(1).write.parquet(os.path.join(src, "part_b"))
    got = J.stream_latest_state(spark, SF_SMALL, out=out, source=os.path.join(src, "*", "*.parquet"))
    exp = {r.loop_id: r.s for r in small.session_traces.groupBy("loop_id").agg(
        F.max_by("step_name", F.struct("ts", "event_id")).alias("s")).collect()}
    assert {r.loop_id: r.current_step for r in got.collect()} == exp


def _layout(spark, scratch, name):
    """The events as five files in time order, reversed or shuffled; the file
    stream takes files by modification time, so they are written in turn."""
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    slices = {"ordered": [0, 1, 2, 3, 4], "reversed": [4, 3, 2, 1, 0], "shuffled": [2, 0, 4, 1, 3]}[name]
    us = F.unix_micros(F.to_timestamp("ts"))
    low, high = ev.select(F.min(us), F.max(us)).first()
    cut = F.least(F.floor((us - low) * 5 / (high - low + 1)), F.lit(4))
    folder = os.path.join(scratch, name)
    for place, k in enumerate(slices):
        ev.filter(cut == k).coalesce(1).write.parquet(os.path.join(folder, f"part_{place}"))
    return os.path.join(folder, "*", "*.parquet")


@pytest.mark.parametrize("name", ["ordered", "reversed", "shuffled"])
def test_streams_give_the_batch_answer_for_any_file_layout(spark, small, scratch, name):
    """J1 and J4 file by file; J2 and J3, whose state closes by event time,
    with all files at hand, and file by file in time order."""
    source = _layout(spark, scratch, name)
    for run in (J.stream_traces, J.stream_hourly_errors, J.stream_gate_dedup, J.stream_latest_state):
        in_time = name == "ordered" or run in (J.stream_traces, J.stream_latest_state)
        many = run(spark, SF_SMALL, source=source, files_per_trigger=1 if in_time else None)
        one = run(spark, SF_SMALL)
        assert many.exceptAll(one).count() == 0 and one.exceptAll(many).count() == 0, run.__name__
    gates = J.stream_gate_dedup(spark, SF_SMALL, source=source, files_per_trigger=1 if name == "ordered" else None)
    effective = (L.first_gate_resolution(small.loop_events).filter("status = 'EFFECTIVE'")
                 .select("loop_id", "gate", "decision", "event_id"))
    got = gates.select("loop_id", "gate", "decision", "event_id")
    assert got.exceptAll(effective).count() == 0 and effective.exceptAll(got).count() == 0


def _event_files(spark, folder, *files):
    """One file of events per list of (event_id, ts, user_id, event_type, props)."""
    for place, rows in enumerate(files):
        df = spark.createDataFrame([(i, u, e, 1.0, p, ts) for i, ts, u, e, p in rows],
                                   "event_id long, user_id long, event_type string, value double, props string, t string")
        df = df.select("event_id", F.expr("cast(t AS timestamp_ntz)").alias("ts"), "user_id", "event_type", "value", "props")
        df.coalesce(1).write.parquet(os.path.join(folder, f"part_{place}"))
    return os.path.join(folder, "*", "*.parquet")


def test_errors_of_closed_windows_are_dropped_and_counted(spark, scratch):
    day = "2026-03-01 "
    source = _event_files(
        spark, os.path.join(scratch, "in"),
        [(1, day + "08:10:00", 1, "error", "k=1"), (2, day + "08:50:00", 1, "error", "k=1"), (3, day + "12:30:00", 1, "error", "k=1")],
        [(7, day + "12:40:00", 1, "error", "k=1")],  # the watermark of a micro-batch holds from the next one on
        [(4, day + "08:20:00", 1, "error", "k=1"),  # its window closed two hours before the newest error
         (5, day + "11:59:00", 1, "error", "k=1")],  # late, but its window is open
        [(6, day + "18:00:00", 1, "error", "k=1")])
    out = os.path.join(scratch, "out")
    query = J.start_hourly_errors(spark, SF_SMALL, out, source, files_per_trigger=1)
    query.awaitTermination()
    got = {str(r.window_start): r.errors for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {day + "08:00:00": 2, day + "11:00:00": 1, day + "12:00:00": 2}
    assert J.late_rows(query) == 1


def test_gate_state_expires(spark, small, scratch):
    """A resolution within the period is a conflict, a later one stands again,
    and the state holds the gates of one period."""
    steps = {r.step_name: r.event_id for r in small.loop_events.filter("decision IS NOT NULL").select("step_name", "event_id").collect()}
    gate = small.session_traces.filter(F.col("event_id").isin(list(steps.values()))).select("event_id", "loop_id").first()
    raw = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).filter(F.col("event_id") == gate.event_id).first()

    def at(ts, user):
        return (gate.event_id, ts, user, raw.event_type, raw.props)

    source = _event_files(
        spark, os.path.join(scratch, "in"), [at("2026-01-01 00:00:00", 1), at("2026-01-01 10:00:00", 2)],
        [at("2026-01-05 00:00:00", 1)], [at("2026-01-30 00:00:00", 3)], [at("2026-02-01 00:00:00", 4)], [at("2026-02-02 00:00:00", 1)])
    out = os.path.join(scratch, "out")
    query = J.start_gate_dedup(spark, SF_SMALL, out, source, files_per_trigger=1, repeat_days=10)
    query.awaitTermination()
    got = sorted((r.loop_id[-1], str(r.ts)[:10]) for r in spark.read.parquet(f"{out}/data").collect())
    assert got == [("1", "2026-01-01"), ("1", "2026-02-02"), ("2", "2026-01-01"), ("3", "2026-01-30"), ("4", "2026-02-01")]
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 3


def test_a_replayed_micro_batch_changes_nothing(spark, scratch):
    table = os.path.join(scratch, "table")
    schema = "loop_id string, current_step string, updated_at timestamp_ntz, event_id long"

    def batch(*rows):
        return spark.createDataFrame([(k, s, None, e) for k, s, e in rows], schema).withColumn(
            "updated_at", F.expr("timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(0, 0, event_id)"))

    def state():
        return {r.loop_id: r.current_step for r in read_committed(spark, table).collect()}

    J.upsert_states(batch(("a", "INTAKE", 1), ("b", "INTAKE", 2)), 0, table)
    J.upsert_states(batch(("a", "SPECIFY", 3), ("c", "INTAKE", 1)), 1, table)
    before, version = state(), CommitLog(spark, table).latest()
    J.upsert_states(batch(("a", "SPECIFY", 3), ("c", "CHANGED", 9)), 1, table)
    J.upsert_states(batch(("a", "LOST", 99)), 0, table)
    assert state() == before == {"a": "SPECIFY", "b": "INTAKE", "c": "INTAKE"} and CommitLog(spark, table).latest() == version
    J.upsert_states(batch(("b", "OLDER", 1)), 2, table)  # rewrites one bucket, keeps the newer row
    log = CommitLog(spark, table)
    assert state() == before and len(log.manifest(log.latest())["add"]) == 1


def test_audit_append_keeps_the_first_and_raises_on_a_broken_table(spark, scratch):
    path = os.path.join(scratch, "audit")
    rows = spark.createDataFrame([("k1", 2, "late"), ("k1", 1, "first"), ("k2", 1, "only")], "object_key string, seq int, v string")
    sinks.append_audit(spark, rows, path, order=("seq",))
    assert {(r.object_key, r.v) for r in read_committed(spark, path).collect()} == {("k1", "first"), ("k2", "only")}
    log = CommitLog(spark, path)
    for name in os.listdir(os.path.join(path, log.live()[0])):
        with open(os.path.join(path, log.live()[0], name), "w") as f:
            f.write("no parquet")
    with pytest.raises(Exception):
        sinks.append_audit(spark, rows, path, order=("seq",))
    assert log.latest() == 1


def test_artifact_folders_by_domain_and_day(spark, small, scratch):
    from ledgerline.operators import catalog as E

    root = os.path.join(scratch, "artifacts")
    records = E.artifact_records(small.artifacts)
    sinks.write_artifacts(records, root)
    back = spark.read.parquet(os.path.join(root, "processes"))
    assert back.count() == records.count() and {"domain", "created_date"} <= set(back.columns)
    assert back.select(*records.columns).exceptAll(records).count() == 0
