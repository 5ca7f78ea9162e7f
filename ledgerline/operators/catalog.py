"""Artifact catalog, audit trail and session telemetry.

Everything is a column expression or a group-by; hashing (``sha2``) is
CPU-bound and shuffle-free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions.canonical import canonical_json, canonical_of, record_json  # noqa: F401 (canonical_json is part of E10)
from ..functions.windows import running, slice_of

DEFAULT_BUCKET = "analytics-artifacts"
DEFAULT_CREATOR = "delivery-engine"


# E2 --------------------------------------------------------------------------
def artifact_type(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return (F.when(n.endswith(".sql"), "SQL_VIEW")
            .when(n == "spec.md", "SPECIFICATION")
            .when(n == "test_results.json", "TEST_REPORT")
            .otherwise("PYTHON_CODE"))


# E1 --------------------------------------------------------------------------
def artifact_id() -> Column:
    return F.concat(F.lit("ART-"), F.upper("domain"), F.lit("-"), F.right("loop_id", F.lit(8)), F.lit("-"),
                    F.replace(F.col("artifact_name"), F.lit("."), F.lit("_")))


def artifact_records(artifacts: DataFrame, bucket: str = DEFAULT_BUCKET,
                     created_by: str = DEFAULT_CREATOR) -> DataFrame:
    """Catalog rows for (domain, loop_id, artifact_name, content[, created_at])."""
    return artifacts.select(
        artifact_id().alias("artifact_id"),
        "loop_id", "domain", "artifact_name",
        artifact_type("artifact_name").alias("artifact_type"),
        F.concat(F.lit(f"gs://{bucket}/processes/"), F.col("domain"), F.lit("/"), F.col("loop_id"), F.lit("/"),
                 F.col("artifact_name")).alias("gcs_uri"),
        F.sha2(F.col("content"), 256).alias("content_sha256"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        "created_at",
        F.lit(created_by).alias("created_by"))


# E3 --------------------------------------------------------------------------
def artifacts_for_loops(records: DataFrame, loops: DataFrame) -> DataFrame:
    """Bulk form of the per-loop lookup: records of the loops in ``loops``."""
    return records.join(loops.select("loop_id").distinct(), "loop_id", "left_semi")


def artifacts_for_loop(records: DataFrame, loop_id: str) -> DataFrame:
    return records.filter(F.col("loop_id") == loop_id)


# E4 --------------------------------------------------------------------------
def artifacts_by_domain(records: DataFrame, domain: str | None = None) -> DataFrame:
    return records if domain is None else records.filter(F.col("domain") == domain)


def artifact_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("domain", "artifact_type").agg(
        F.count(F.lit(1)).alias("artifacts"), F.sum("size_bytes").alias("total_bytes"))


# E5-E7 -----------------------------------------------------------------------
def recent_artifacts(artifacts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest artifacts; only their contents are hashed."""
    newest = artifacts.orderBy(F.col("created_at").desc(), artifact_id().desc()).limit(n)
    return artifact_records(newest).select("artifact_id", "domain", "loop_id", "artifact_name", "artifact_type",
                                           "gcs_uri", "content_sha256", "created_at")


def _trace_cols(traces: DataFrame) -> DataFrame:
    return traces.select(
        F.col("loop_id").alias("session_id"), "node_id", "step_name", "duration_ms",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "status", F.col("ts").alias("timestamp"), "event_id")


def recent_traces(traces: DataFrame, n: int = 20) -> DataFrame:
    t = _trace_cols(traces)
    return (t.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(n)
            .select("session_id", "node_id", "step_name", "duration_ms", "total_tokens", "status", "timestamp"))


def gate_audit(traces: DataFrame, n: int = 50) -> DataFrame:
    t = _trace_cols(traces)
    return (t.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(n)
            .select("session_id", "node_id", "step_name", "status", "timestamp"))


# E8 --------------------------------------------------------------------------
def events_in_arrival_order(traces: DataFrame) -> DataFrame:
    """Every loop's telemetry numbered in arrival order (ts, event_id).
    The rank is a running count split by day (skew-safe)."""
    t = traces.select("loop_id", "event_id", "step_name", "ts").withColumn("slice", slice_of("ts"))
    t = running(t, ["loop_id"], "slice", ["ts", "event_id"], F.lit(1), "arrival_seq")
    return t.drop("slice")


def events_for_loop(traces: DataFrame, loop_id: str) -> DataFrame:
    return traces.filter(F.col("loop_id") == loop_id).orderBy("ts", "event_id")


# E9 --------------------------------------------------------------------------
LATENCY_SLA_MS = 250.0
MAX_ERROR_RATE_PCT = 0.1


def health_30d(traces: DataFrame, days: int = 30) -> DataFrame:
    """Health per domain over the last ``days`` days of the data (the newest
    trace timestamp is "now"; a scalar subquery, not a join)."""
    now = traces.select(F.max("ts")).scalar()
    recent = traces.filter(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS"))
    g = recent.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("executions"),
        fx.fine_avg("duration_ms", 3).alias("avg_latency_ms"),
        F.count_if(F.col("status") == "FAILED").alias("_failed"))
    g = g.withColumn("error_rate_pct", fx.half_up_ratio("_failed", "executions", 2, 100))
    sla = (F.col("avg_latency_ms") < F.lit(LATENCY_SLA_MS)) & (F.col("error_rate_pct") <= F.lit(MAX_ERROR_RATE_PCT))
    return (g.withColumn("sla_conformance", sla)
            .withColumn("status", F.when(sla, "HEALTHY").otherwise("DEGRADED"))
            .drop("_failed"))


# E10-E11 ---------------------------------------------------------------------
def audit_hash(audit: DataFrame) -> DataFrame:
    """Hash of each record's canonical payload, of any nested type."""
    return audit.select("loop_id", "seq", F.sha2(canonical_of(audit, "payload"), 256).alias("state_snapshot_hash"))


def audit_event_id(loop_id: Column | str, seq: Column | str) -> Column:
    return F.concat(F.lit("EVT-"), F.left(F.col(loop_id) if isinstance(loop_id, str) else loop_id, F.lit(8)),
                    F.lit("-"), F.format_string("%04d", seq))


def audit_keys(audit: DataFrame, keep: list[str] | None = None) -> DataFrame:
    eid = audit_event_id("loop_id", "seq")
    return audit.select(
        *(keep or []),
        "loop_id", "seq", eid.alias("event_id"),
        F.concat(F.lit("audit/"), F.col("node_id"), F.lit("/"), F.col("loop_id"), F.lit("/"),
                 F.format_string("%08d", "seq"), F.lit("/"), eid, F.lit(".json")).alias("object_key"))


def audit_records(audit: DataFrame) -> DataFrame:
    """The sealed record of every audit row as one object: its key, its
    canonical JSON text and that text's hash."""
    sealed = audit_keys(audit.select("loop_id", "seq", "node_id", "payload", "ts", "actor_email", "actor_type", "intent_kind"),
                        keep=["payload", "ts", "actor_email", "actor_type", "intent_kind", "node_id"])
    sealed = sealed.withColumn("state_snapshot_hash", F.sha2(canonical_of(sealed, "payload"), 256)).withColumnsRenamed(
        {"payload": "payload_summary", "ts": "timestamp"})
    text = record_json(sealed, ["event_id", "loop_id", "node_id", "seq", "intent_kind", "actor_email", "actor_type",
                                "state_snapshot_hash", "payload_summary", "timestamp"])
    return sealed.select("loop_id", "seq", "object_key", text.alias("record")).withColumn("record_sha256", F.sha2("record", 256))


# E12 -------------------------------------------------------------------------
def audit_integrity(audit: DataFrame, first_seq: int = 1) -> DataFrame:
    """Per loop with a defect: hash mismatches, missing and repeated seq.
    Records are numbered from ``first_seq``, so missing first records count;
    a cut tail shows only if the number of records was sealed elsewhere."""
    recomputed = F.sha2(canonical_of(audit, "payload"), 256)
    g = audit.groupBy("loop_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("seq").alias("_distinct"),
        F.max("seq").alias("_max"),
        F.count_if(recomputed != F.col("stored_hash")).alias("hash_mismatches"))
    g = (g.withColumn("missing_seq", F.col("_max") - F.lit(first_seq) + 1 - F.col("_distinct"))
         .withColumn("repeated_seq", F.col("records") - F.col("_distinct"))
         .drop("_distinct", "_max"))
    return g.filter((F.col("missing_seq") > 0) | (F.col("repeated_seq") > 0) | (F.col("hash_mismatches") > 0))


# Step that produces an artifact of a type.
PRODUCING_STEP = {"SPECIFICATION": "SPECIFY", "SQL_VIEW": "IMPLEMENT", "PYTHON_CODE": "IMPLEMENT", "TEST_REPORT": "REVIEW"}


def artifact_integrity(records: DataFrame, stored: DataFrame, audit: DataFrame) -> DataFrame:
    """Catalog, store and audit trail against each other: one row per artifact
    with a defect.

    ``stored`` is the hierarchy as found (``sinks.read_artifacts``): its
    contents are hashed again and the folder that holds an artifact is compared
    with the catalog's domain and day.  ``lost``: catalogued, not stored;
    ``uncatalogued``: stored, not catalogued; ``edited``: some copy has other
    content; ``moved``: some copy lies in another folder; ``repeated``: more
    than one copy; ``unaudited``: the loop's trail has records, but none of the
    step that produces such an artifact."""
    key = ["loop_id", "artifact_name"]
    copies = stored.select(*key, F.sha2("content", 256).alias("sha"), "folder").groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"), F.min("sha").alias("_s1"), F.max("sha").alias("_s2"),
        F.min("folder").alias("_f1"), F.max("folder").alias("_f2"))
    listed = records.select(*key, "domain", "artifact_type", "content_sha256",
                            F.concat(F.col("domain"), F.lit("/"), F.date_format("created_at", "yyyy-MM-dd")).alias("_place"))
    trail = audit.groupBy("loop_id").agg(*[F.max((F.col("step_name") == s).cast("int")).alias(f"_{s}")
                                           for s in sorted(set(PRODUCING_STEP.values()))])
    made = None
    for kind, step in PRODUCING_STEP.items():
        test = F.col("artifact_type") == kind
        made = F.when(test, F.col(f"_{step}")) if made is None else made.when(test, F.col(f"_{step}"))
    no = F.lit(False)
    found = listed.join(copies, key, "full").join(trail, "loop_id", "left").select(
        *key, "domain", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        (F.col("content_sha256").isNotNull() & F.col("copies").isNull()).alias("lost"),
        F.col("content_sha256").isNull().alias("uncatalogued"),
        F.coalesce((F.col("_s1") != F.col("content_sha256")) | (F.col("_s2") != F.col("content_sha256")), no).alias("edited"),
        F.coalesce((F.col("_f1") != F.col("_place")) | (F.col("_f2") != F.col("_place")), no).alias("moved"),
        F.coalesce(F.col("copies") > 1, no).alias("repeated"), F.coalesce(made == 0, no).alias("unaudited"))
    return found.filter("lost OR uncatalogued OR edited OR moved OR repeated OR unaudited")


# E13 -------------------------------------------------------------------------
def id_collisions(audit: DataFrame, records: DataFrame) -> DataFrame:
    """Derived ids shared by more than one loop."""
    ev = (audit.select(F.lit("event_id").alias("id_kind"), audit_event_id("loop_id", "seq").alias("derived_id"),
                       "loop_id"))
    art = records.select(F.lit("artifact_id").alias("id_kind"), F.col("artifact_id").alias("derived_id"), "loop_id")
    g = ev.unionByName(art).groupBy("id_kind", "derived_id").agg(F.countDistinct("loop_id").alias("loops"))
    return g.filter(F.col("loops") > 1)


# E14 -------------------------------------------------------------------------
# Token prices of the cost model (USD per million tokens).
PRICE_IN_PER_M = "0.075"
PRICE_OUT_PER_M = "0.30"


def token_cost(traces: DataFrame) -> DataFrame:
    g = traces.groupBy("node_id", "loop_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    # price in USD per token = (per-M price) / 1e6; in 1e-9 USD units: 75 and 300.
    nano = F.col("input_tokens") * 75 + F.col("output_tokens") * 300
    return g.withColumn("cost_usd", nano.cast("double") / F.lit(1e9))


# E15 -------------------------------------------------------------------------
SPAN_SLICE_MS = 16.0  # width of the slices in which span durations are ranked
SPAN_DEFAULT_ATTRS = {"gen_ai.system": "model-provider", "gen_ai.request.model": "default-model"}


def spans(traces: DataFrame, caller_attrs: Column | None = None) -> DataFrame:
    """One span per trace row: name ``pipeline.node.<step>``, default attributes
    overridden by caller keys (the caller map wins on duplicate keys)."""
    defaults = F.create_map(
        F.lit("run.loop_id"), F.col("loop_id"), F.lit("run.node_name"), F.col("step_name"),
        *[x for k, v in SPAN_DEFAULT_ATTRS.items() for x in (F.lit(k), F.lit(v))])
    if caller_attrs is None:
        attrs = defaults
    else:
        keep = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(caller_attrs), k))
        attrs = F.map_concat(keep, caller_attrs)
    return traces.select(
        F.concat(F.lit("pipeline.node."), F.lower("step_name")).alias("span_name"),
        "loop_id", "duration_ms", attrs.alias("attributes"))


def attributes_text(attrs: Column | str) -> Column:
    """Canonical text of an attribute map: ``k=v`` pairs sorted by key, ``;``."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.array_join(F.transform(F.array_sort(F.map_entries(a)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def span_rows(traces: DataFrame) -> DataFrame:
    """Span per trace row with the caller's attributes (model, status)
    overriding the defaults; attributes rendered as sorted text."""
    caller = F.create_map(F.lit("gen_ai.request.model"), F.col("model_name"), F.lit("status"), F.col("status"))
    s = spans(traces.select("event_id", "loop_id", "step_name", "duration_ms", "model_name", "status"), caller)
    return s.select("span_name", "loop_id", "duration_ms", attributes_text("attributes").alias("attributes"))


def span_stats(traces: DataFrame) -> DataFrame:
    """Per span name: count, average, p50, p95 duration.

    Percentiles are exact without a value map: durations are counted per
    (span, duration), ranked by a prefix sum in slices of the duration, and
    the two durations at the ranks of a percentile are interpolated."""
    s = spans(traces).select("span_name", F.col("duration_ms").cast("double").alias("x"), "duration_ms")
    totals = s.groupBy("span_name").agg(F.count(F.lit(1)).alias("spans"), F.count("x").alias("n"),
                                        fx.fine_avg("duration_ms", 2).alias("avg_ms"))
    values = (s.filter(F.col("x").isNotNull()).groupBy("span_name", "x").agg(F.count(F.lit(1)).alias("times"))
              .withColumn("slice", F.floor(F.col("x") / SPAN_SLICE_MS)))
    ranked = running(values, ["span_name"], "slice", ["x"], "times", "upto").join(
        totals.select("span_name", "n"), "span_name")
    picks, out = [], []
    for name, q in (("p50_ms", 0.5), ("p95_ms", 0.95)):
        at = (F.col("n") - 1) * F.lit(q)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            hit = (F.col("upto") > rank) & (F.col("upto") - F.col("times") <= rank)
            picks.append(F.max(F.when(hit, F.col("x"))).alias(f"{name}_{side}"))
        part = at - F.floor(at)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        # Rounded to 6 places: the values have few decimals, and engines
        # differ only in floating-point noise.
        out.append(F.round(low + (high - low) * part, 6).alias(name))
    picked = ranked.groupBy("span_name").agg(*picks)
    return totals.join(picked, "span_name", "left").select("span_name", "spans", "avg_ms", *out)
