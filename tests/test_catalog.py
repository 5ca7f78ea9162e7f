"""Artifact catalog, audit and telemetry (E*)."""
import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from ledgerline.operators import catalog as E


def test_artifact_record_golden(spark):
    content = "# Feature: FX Variance Analysis\nGiven exchange rates..."
    df = spark.createDataFrame([("finance", "01KZZTEST001", "spec.md", content, datetime(2026, 1, 1))],
                               "domain string, loop_id string, artifact_name string, content string, "
                               "created_at timestamp_ntz")
    r = E.artifact_records(df, bucket="test-artifacts").first()
    assert r.gcs_uri == "gs://test-artifacts/processes/finance/01KZZTEST001/spec.md"
    assert r.artifact_type == "SPECIFICATION"
    assert r.content_sha256 == hashlib.sha256(content.encode()).hexdigest()
    assert r.size_bytes == len(content.encode())
    assert r.artifact_id == "ART-FINANCE-ZTEST001-spec_md"


def test_artifact_types(spark):
    names = ["query.sql", "spec.md", "test_results.json", "transform.py", "review_outcome"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string")
           .select(E.artifact_type("n").alias("t")).collect()]
    assert got == ["SQL_VIEW", "SPECIFICATION", "TEST_REPORT", "PYTHON_CODE", "PYTHON_CODE"]


def test_canonical_json_hash_equals_python(spark):
    payloads = [{"step": "INTAKE", "loop_id": "01KZZ1"}, {"b": 'q"uote', "a": "back\\slash"}, {}]
    df = spark.createDataFrame([(p,) for p in payloads], "payload map<string,string>")
    got = [r.h for r in df.select(F.sha2(E.canonical_json("payload"), 256).alias("h")).collect()]
    exp = [hashlib.sha256(json.dumps(p, sort_keys=True).encode()).hexdigest() for p in payloads]
    assert got == exp


def test_audit_event_ids(spark):
    df = spark.createDataFrame([("01KZZ20260101", "finance", 7), ("01KZZ20260101", "finance", 12345)],
                               "loop_id string, node_id string, seq long")
    got = [(r.event_id, r.object_key) for r in E.audit_keys(df).collect()]
    assert got[0] == ("EVT-01KZZ202-0007", "audit/finance/01KZZ20260101/00000007/EVT-01KZZ202-0007.json")
    assert got[1][0] == "EVT-01KZZ202-12345"  # Python's {:04d} never truncates


def test_events_in_arrival_order(spark):
    rows = [("L1", 3, datetime(2024, 1, 1, 0, 0, 2), "SPEC_HARNESS"),
            ("L1", 1, datetime(2024, 1, 1, 0, 0, 0), "INTAKE"),
            ("L1", 2, datetime(2024, 1, 1, 0, 0, 1), "SPECIFY")]
    df = spark.createDataFrame(rows, "loop_id string, event_id long, ts timestamp_ntz, step_name string")
    got = [r.step_name for r in E.events_in_arrival_order(df).orderBy("arrival_seq").collect()]
    assert got == ["INTAKE", "SPECIFY", "SPEC_HARNESS"]


def test_span_attributes_caller_wins(spark):
    df = spark.createDataFrame([("L1", "INTAKE", 1.0)], "loop_id string, step_name string, duration_ms double")
    caller = F.create_map(F.lit("gen_ai.request.model"), F.lit("custom"), F.lit("extra"), F.lit("1"))
    r = E.spans(df, caller).first()
    assert r.span_name == "pipeline.node.intake"
    assert r.attributes["gen_ai.request.model"] == "custom" and r.attributes["extra"] == "1"
    assert r.attributes["run.loop_id"] == "L1"


def test_token_cost(spark):
    df = spark.createDataFrame([("finance", "L1", 1_000_000, 1_000_000)],
                               "node_id string, loop_id string, input_tokens long, output_tokens long")
    assert E.token_cost(df).first().cost_usd == 0.375


def test_canonical_json_equals_python(spark):
    import json

    from ledgerline.operators import catalog as E

    texts = ["plain", 'quote " and \\ slash', "line\nfeed\ttab\r\b\f", "caf\u00e9 \u6f22\u5b57 \U0001f600", "\x00\x1f\x7f", ""]
    rows = [(i, {"b": t, "a\u00fc": t + "x"}) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, payload map<string,string>").select("i", "payload", E.canonical_json("payload").alias("j"))
    for r in df.collect():
        assert r.j == json.dumps(r.payload, sort_keys=True)


def test_nested_payload_hash_and_sealed_record_equal_python(spark):
    schema = ("loop_id string, node_id string, seq long, ts timestamp_ntz, actor_email string, actor_type string, intent_kind string, "
              "payload struct<z:array<string>,a:struct<on:boolean,x:double>>")
    payload = {"z": ["1", None, 'q"é'], "a": {"on": True, "x": 0.1}}
    df = spark.createDataFrame([("01KZZ20260101", "finance", 7, datetime(2026, 1, 1, 2, 3, 4, 5), "a@b.c", "agent", "STATE", payload)], schema)
    text = json.dumps(payload, sort_keys=True)
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert E.audit_hash(df).first().state_snapshot_hash == sha
    r = E.audit_records(df).first()
    record = {"event_id": "EVT-01KZZ202-0007", "loop_id": "01KZZ20260101", "node_id": "finance", "seq": 7, "intent_kind": "STATE",
              "actor_email": "a@b.c", "actor_type": "agent", "state_snapshot_hash": sha, "payload_summary": payload,
              "timestamp": "2026-01-01T02:03:04.000005"}
    assert r.record == json.dumps(record, sort_keys=True)
    assert r.record_sha256 == hashlib.sha256(r.record.encode()).hexdigest()
    assert r.object_key == "audit/finance/01KZZ20260101/00000007/EVT-01KZZ202-0007.json"


def test_artifact_integrity_reports_each_planted_defect(spark, scratch):
    from ledgerline.sources import sinks

    day = datetime(2026, 1, 2, 3)
    names = ["fine", "lost", "edited", "moved", "moved_day", "repeated", "unaudited"]
    rows = [(n, "sales", "query.sql", f"SELECT '{n}'", day) for n in names]
    schema = "loop_id string, domain string, artifact_name string, content string, created_at timestamp_ntz"
    records = E.artifact_records(spark.createDataFrame(rows, schema), bucket="b")
    stored = [r for r in rows if r[0] != "lost"] + [rows[5], ("stray", "sales", "notes.txt", "x", day)]
    stored[1] = ("edited", "sales", "query.sql", "SELECT 'other'", day)
    stored[2] = ("moved", "finance", *rows[3][2:])
    stored[3] = ("moved_day", "sales", "query.sql", rows[4][3], datetime(2026, 1, 3))
    sinks.write_artifacts(spark.createDataFrame(stored, schema).withColumn("artifact_id", F.col("loop_id")), scratch)
    audit = spark.createDataFrame([(n, "IMPLEMENT") for n in names[:3]] + [("unaudited", "SPECIFY")], "loop_id string, step_name string")
    flags = ["lost", "uncatalogued", "edited", "moved", "repeated", "unaudited"]
    got = {r.loop_id: ([f for f in flags if r[f]], r.copies)
           for r in E.artifact_integrity(records, sinks.read_artifacts(spark, scratch), audit).collect()}
    assert got == {"lost": (["lost"], 0), "edited": (["edited"], 1), "moved": (["moved"], 1), "moved_day": (["moved"], 1),
                   "repeated": (["repeated"], 2), "unaudited": (["unaudited"], 1), "stray": (["uncatalogued"], 1)}
