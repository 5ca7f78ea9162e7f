"""Registered queries: name -> (Spark plan over a :class:`Tables`, oracle SQL).

Every query reads whole driver tables (through the adapters), so its work
grows with the data.  ``queries()`` / ``oracle_sql()`` in
``__spark_entry__.py`` are generated from here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pyspark.sql import functions as _F

from ..operators import views as V
from ..sources.tables import Tables
from .oracle_views import ORACLE as ORACLE_VIEWS

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _reg(name: str, plan: Callable[[Tables], DataFrame], oracle: dict[str, str] | None = None) -> None:
    PLANS[name] = plan
    if oracle is not None and name in oracle:
        ORACLE[name] = oracle[name]


# B: domain views
_reg("weekly_revenue_variance", lambda t: V.weekly_revenue_variance(t.invoices, t.exchange_rates), ORACLE_VIEWS)
_reg("sales_pipeline_conversion", lambda t: V.sales_pipeline_conversion(t.opportunities), ORACLE_VIEWS)
# The stamp itself differs from run to run; that it is there and of this run does not
_reg("sales_pipeline_stamped", lambda t: V.sales_pipeline_conversion(t.opportunities, with_ts=True).withColumn(
    "stamped", _F.abs(_F.unix_micros("computed_at") - _F.unix_micros(_F.current_timestamp())) < 3_600_000_000).drop("computed_at"),
    {"sales_pipeline_stamped": f"SELECT *, true AS stamped FROM ({ORACLE_VIEWS['sales_pipeline_conversion']}) AS v"})
_reg("charger_telemetry_agg", lambda t: V.charger_telemetry_agg(t.charger_telemetry), ORACLE_VIEWS)
_reg("campaign_attribution", lambda t: V.campaign_attribution(t.campaign_events, t.user_acquisitions), ORACLE_VIEWS)
_reg("inventory_turnover_view", lambda t: V.inventory_turnover_view(t.inventory, t.warehouse_dispatch), ORACLE_VIEWS)
_reg("weekly_fx_variance", lambda t: V.weekly_fx_variance(t.invoices, t.exchange_rate_history), ORACLE_VIEWS)
_reg("monthly_pipeline_by_stage", lambda t: V.monthly_pipeline_by_stage(t.opportunities), ORACLE_VIEWS)
_reg("hourly_error_telemetry", lambda t: V.hourly_error_telemetry(t.error_logs, t.charger_telemetry), ORACLE_VIEWS)
_reg("reorder_alert", lambda t: V.reorder_alert(t.inventory), ORACLE_VIEWS)
_reg("dispatch_sla_adherence", lambda t: V.dispatch_sla_adherence(t.warehouse_dispatch), ORACLE_VIEWS)
_reg("reconciliation_status",
     lambda t: V.reconciliation_status(V.weekly_fx_variance(t.invoices, t.exchange_rate_history)), ORACLE_VIEWS)
_reg("revenue_summary", lambda t: V.revenue_summary(t.invoices), ORACLE_VIEWS)
_reg("charger_health", lambda t: V.charger_health(t.charger_telemetry, t.error_logs), ORACLE_VIEWS)
_reg("telemetry_ingestion_delay", lambda t: V.telemetry_ingestion_delay(t.charger_telemetry), ORACLE_VIEWS)
_reg("channel_cac", lambda t: V.channel_cac(t.ad_spend, t.user_acquisitions, t.campaign_events), ORACLE_VIEWS)
_reg("weighted_pipeline", lambda t: V.weighted_pipeline(t.opportunities), ORACLE_VIEWS)
_reg("funnel_conversion", lambda t: V.funnel_conversion(t.campaign_events), ORACLE_VIEWS)
_reg("cohort_retention", lambda t: V.cohort_retention(t.campaign_events), ORACLE_VIEWS)
_reg("energy_billing", lambda t: V.energy_billing(t.billing_events), ORACLE_VIEWS)
_reg("multi_touch_attribution", lambda t: V.multi_touch_attribution(t.campaign_events), ORACLE_VIEWS)
_reg("attributed_cac", lambda t: V.attributed_cac(t.campaign_events, t.campaign_spend), ORACLE_VIEWS)

# C: formulas applied to whole tables
from ..operators import formula_queries as C  # noqa: E402
from .oracle_formulas import ORACLE as ORACLE_FORMULAS  # noqa: E402

_reg("stage_conversion_rate", lambda t: C.stage_conversion_rate(t.opportunities), ORACLE_FORMULAS)
_reg("mask_pii", lambda t: C.mask_account_names(t.opportunities), ORACLE_FORMULAS)
_reg("parse_telemetry", lambda t: C.parse_telemetry(t.charger_telemetry), ORACLE_FORMULAS)
_reg("safe_temperature", lambda t: C.safe_temperature(t.charger_telemetry), ORACLE_FORMULAS)
_reg("cac_monthly", lambda t: C.cac_monthly(t.ad_spend, t.user_acquisitions, t.campaign_events), ORACLE_FORMULAS)
_reg("consent_filter", lambda t: C.consent_filtered_events(t.campaign_events), ORACLE_FORMULAS)
_reg("inventory_turnover", lambda t: C.inventory_turnover(t.inventory, t.parts_catalog), ORACLE_FORMULAS)
_reg("dispatch_sla_met", lambda t: C.dispatch_sla_met(t.warehouse_dispatch), ORACLE_FORMULAS)
_reg("convert_currency", lambda t: C.convert_currency(t.invoices, t.exchange_rate_history), ORACLE_FORMULAS)
_reg("pct_variance", lambda t: C.monthly_revenue_variance(t.invoices), ORACLE_FORMULAS)

# E: artifact catalog, audit, telemetry
from ..operators import catalog as E  # noqa: E402
from .oracle_catalog import ORACLE as ORACLE_CATALOG  # noqa: E402


def _failed_loops(t: Tables) -> DataFrame:
    tr = t.test_results.filter(~_F.col("passed"))
    return tr.select(_F.concat(_F.lit("01KZZ"), _F.lpad(tr["run_id"].cast("string"), 14, "0")).alias("loop_id"))


_reg("artifact_records", lambda t: E.artifact_records(t.artifacts), ORACLE_CATALOG)
_reg("artifacts_for_loop", lambda t: E.artifacts_for_loops(E.artifact_records(t.artifacts), _failed_loops(t)),
     ORACLE_CATALOG)
_reg("artifacts_by_domain", lambda t: E.artifact_summary(E.artifact_records(t.artifacts)), ORACLE_CATALOG)
_reg("recent_artifacts", lambda t: E.recent_artifacts(t.artifacts), ORACLE_CATALOG)
_reg("recent_traces", lambda t: E.recent_traces(t.session_traces), ORACLE_CATALOG)
_reg("gate_audit", lambda t: E.gate_audit(t.session_traces), ORACLE_CATALOG)
_reg("events_for_loop", lambda t: E.events_in_arrival_order(t.session_traces), ORACLE_CATALOG)
_reg("health_30d", lambda t: E.health_30d(t.session_traces), ORACLE_CATALOG)
_reg("audit_hash", lambda t: E.audit_hash(t.audit_events), ORACLE_CATALOG)
_reg("audit_records", lambda t: E.audit_records(t.audit_events).drop("record"), ORACLE_CATALOG)
_reg("audit_keys", lambda t: E.audit_keys(t.audit_events), ORACLE_CATALOG)
_reg("audit_integrity", lambda t: E.audit_integrity(t.audit_events), ORACLE_CATALOG)
_reg("id_collisions", lambda t: E.id_collisions(t.audit_events, E.artifact_records(t.artifacts)), ORACLE_CATALOG)
_reg("token_cost", lambda t: E.token_cost(t.session_traces), ORACLE_CATALOG)
_reg("span_stats", lambda t: E.span_stats(t.session_traces), ORACLE_CATALOG)
_reg("span_rows", lambda t: E.span_rows(t.session_traces), ORACLE_CATALOG)

# F: specification / document quality checks
from ..operators import quality as Q  # noqa: E402
from .oracle_quality import ORACLE as ORACLE_QUALITY  # noqa: E402


def _rule(fn):
    def plan(t: Tables) -> DataFrame:
        return Q.rule_report(Q.with_case_folds(t.specs), fn())
    return plan


_reg("spec_frontmatter", _rule(lambda: Q.frontmatter_violations("text", _F.col("_fm"))), ORACLE_QUALITY)
_reg("spec_required_fields", _rule(lambda: Q.required_field_violations("text", _F.col("_fm"), _F.col("_keys"), _F.col("_defect"))),
     ORACLE_QUALITY)
_reg("spec_gherkin", _rule(lambda: Q.gherkin_violations("text")), ORACLE_QUALITY)
_reg("spec_metrics_section", _rule(lambda: Q.metrics_section_violations("text")), ORACLE_QUALITY)
_reg("spec_prohibited_sql", _rule(lambda: Q.prohibited_sql_violations("text", "node_id", _F.col("_uc"))),
     ORACLE_QUALITY)
_reg("spec_missing_metrics", _rule(lambda: Q.missing_metric_violations("text", "node_id")), ORACLE_QUALITY)
_reg("tier1_violations", _rule(lambda: Q.tier1_violations("text", "node_id", **Q.features())), ORACLE_QUALITY)
_reg("tier2_policy", _rule(lambda: Q.tier2_violations("text", _F.col("_lc"), _F.col("_lines"))), ORACLE_QUALITY)
_reg("rule_usage", lambda t: Q.rule_usage(t.specs), ORACLE_QUALITY)
_reg("spec_harness", lambda t: Q.spec_harness(t.specs), ORACLE_QUALITY)
_reg("acceptance_criteria", lambda t: Q.acceptance_report(t.test_results), ORACLE_QUALITY)
_reg("review_outcome", lambda t: Q.review_outcome(t.test_results), ORACLE_QUALITY)
_reg("forbidden_code_scan", lambda t: Q.forbidden_code_scan(t.artifacts), ORACLE_QUALITY)
_reg("guardrail_tokens", lambda t: Q.guardrail_scan(t.conversation_turns), ORACLE_QUALITY)
_reg("metric_defaults", lambda t: Q.metric_defaults(t.specs), ORACLE_QUALITY)
_reg("violation_summary", lambda t: Q.violation_summary(t.specs), ORACLE_QUALITY)

# G: run scoring
from ..operators import scoring as G  # noqa: E402
from .oracle_scoring import ORACLE as ORACLE_SCORING  # noqa: E402


def _sessions(t: Tables) -> DataFrame:
    return G.harvest_sessions(t.session_traces, t.loop_events)


def _keyed_sessions(t: Tables) -> DataFrame:
    """Sessions of the fixture with the number in their id as run key (NULL
    for an id of another form)."""
    return _sessions(t).withColumn("run_key", _F.expr("try_cast(substring(loop_id, 6) AS bigint)"))


def _report(t: Tables) -> DataFrame:
    return G.flywheel_report(_keyed_sessions(t), t.conversation_turns)


_reg("harvest_traces", _sessions, ORACLE_SCORING)
_reg("trajectory_score", lambda t: G.trajectory_score(_sessions(t)), ORACLE_SCORING)
_reg("gherkin_score", lambda t: Q.with_case_folds(t.specs).select(
    "doc_id", G.gherkin_score("text", "node_id", Q.features()).alias("gherkin_score")), ORACLE_SCORING)
_reg("skill_score", lambda t: Q.with_case_folds(t.specs).select(
    "doc_id", G.skill_score("text", "node_id", _F.col("_uc")).alias("skill_score")), ORACLE_SCORING)
_reg("sandbox_score", lambda t: t.test_results.select(
    "run_id", G.sandbox_score("pass_rate", "exit_code").alias("sandbox_score")), ORACLE_SCORING)
_reg("scorecard", lambda t: G.scorecard(_keyed_sessions(t), t.specs, t.test_results), ORACLE_SCORING)
_reg("protocol_scorecard", lambda t: G.protocol_scorecard(t.response_log), ORACLE_SCORING)
_reg("task_success", lambda t: _report(t).select("loop_id", "task_success"), ORACLE_SCORING)
_reg("tool_use_score", lambda t: _report(t).select("loop_id", "tool_use_quality"), ORACLE_SCORING)
_reg("instruction_score", lambda t: _report(t).select("loop_id", "instruction_following"), ORACLE_SCORING)
_reg("flywheel_report", _report, ORACLE_SCORING)
_reg("loss_clusters", lambda t: G.loss_clusters(_report(t)), ORACLE_SCORING)
_reg("suite_summary", lambda t: G.suite_summary({
    "delivery": G.scorecard(_keyed_sessions(t), t.specs, t.test_results),
    "protocol": G.protocol_scorecard(t.response_log), "flywheel": _report(t)}), ORACLE_SCORING)

# H: classification, identity, access
from ..operators import access as H  # noqa: E402
from .oracle_access import ORACLE as ORACLE_ACCESS  # noqa: E402

_reg("delivery_path", lambda t: H.delivery_path(t.briefs), ORACLE_ACCESS)
_reg("domain_route", lambda t: H.domain_routes(t.briefs), ORACLE_ACCESS)
_reg("access_decision", lambda t: H.access_decisions(t.actors), ORACLE_ACCESS)
_reg("normalize_identity", lambda t: H.normalize_identity(t.actors), ORACLE_ACCESS)
_reg("actor_split", lambda t: H.actor_split(t.audit_log), ORACLE_ACCESS)
_reg("table_allowlist", lambda t: H.table_allowlist(t.briefs), ORACLE_ACCESS)
_reg("default_roles", lambda t: H.default_role_grants(t.actors), ORACLE_ACCESS)

# I: lifecycle of the loop event log
from ..operators import lifecycle as L  # noqa: E402


def _transitions(t: Tables) -> DataFrame:
    return L.transitions(t.loop_events)


_reg("next_state", lambda t: L.next_state(t.loop_events, t.harness_reports), ORACLE_ACCESS)
_reg("retry_budget", lambda t: L.retry_budget(t.loop_events, t.harness_reports), ORACLE_ACCESS)
_reg("total_retries", lambda t: L.total_retries(L.retry_budget(t.loop_events)), ORACLE_ACCESS)
_reg("first_gate_resolution", lambda t: L.first_gate_resolution(t.loop_events), ORACLE_ACCESS)
_reg("latest_loop_state", lambda t: L.latest_loop_state(_transitions(t)), ORACLE_ACCESS)
_reg("pending_gates", lambda t: L.pending_gates(L.latest_loop_state(_transitions(t)), t.loop_events), ORACLE_ACCESS)
_reg("step_limit", lambda t: L.step_limit(_transitions(t)), ORACLE_ACCESS)
_reg("stage_durations", lambda t: L.stage_durations(t.loop_events), ORACLE_ACCESS)

# A: typed tables and schema catalog
from ..sources import schemas as S  # noqa: E402
from .oracle_sources import ORACLE as ORACLE_SOURCES  # noqa: E402

for _tables in S.CATALOG.values():
    for _tbl in _tables:
        _reg(f"table_{_tbl}", (lambda name: lambda t: S.typed(t.get(name), name))(_tbl), ORACLE_SOURCES)
_reg("table_schema", S.schema_catalog, ORACLE_SOURCES)
_reg("list_tables", S.table_listing, ORACLE_SOURCES)
_reg("schema_context", S.schema_context, ORACLE_SOURCES)
_reg("required_null_counts", S.required_null_counts, ORACLE_SOURCES)

# Sinks, written under the checkpoint folder and read back
from uuid import uuid4  # noqa: E402

from ..session import checkpoint_dir as _checkpoint_dir  # noqa: E402
from ..sources import sinks as K  # noqa: E402
from ..sources.commits import read_committed  # noqa: E402


def _sink(t: Tables, name: str, columns: list[str], write) -> DataFrame:
    root = f"{_checkpoint_dir(t.spark).rstrip('/')}/sinks/{name}-{uuid4().hex}"
    write(root)
    return read_committed(t.spark, root).select(*columns)


def _sink_typed(t: Tables, name: str, write) -> DataFrame:
    rows = S.typed(t.get(name), name)
    return _sink(t, name, rows.columns, lambda root: write(rows, root))


def _published(t: Tables) -> DataFrame:
    view = V.weekly_revenue_variance(t.invoices, t.exchange_rates)
    return t.spark.table(K.publish_view(view, "finance", {"finance": "finance_weekly_revenue"}))


def _stored_artifacts(t: Tables) -> DataFrame:
    records = E.artifact_records(t.artifacts)
    root = f"{_checkpoint_dir(t.spark).rstrip('/')}/sinks/artifacts-{uuid4().hex}"
    K.write_artifacts(records, root)
    return t.spark.read.parquet(f"{root}/processes").select(*records.columns)


def _artifact_integrity(t: Tables) -> DataFrame:
    """The planted store is written as the hierarchy, read back from its files
    and compared."""
    root = f"{_checkpoint_dir(t.spark).rstrip('/')}/sinks/store-{uuid4().hex}"
    planted = t.stored_artifacts.withColumn("artifact_id", _F.concat_ws("-", "loop_id", "artifact_name")).drop("doc_id")
    K.write_artifacts(planted, root)
    return E.artifact_integrity(E.artifact_records(t.artifacts), K.read_artifacts(t.spark, root), t.audit_log)


def _sealed_audit(t: Tables) -> DataFrame:
    """Audit keys appended, then appended again with another event id: what
    was sealed first stays."""
    keys = E.audit_keys(t.audit_events)

    def write(root: str) -> None:
        K.append_audit(t.spark, keys, root, order=("seq",))
        K.append_audit(t.spark, keys.withColumn("event_id", _F.lit("CHANGED")), root, order=("seq",))

    return _sink(t, "audit", keys.columns, write)


_reg("sink_view", _published, {"sink_view": ORACLE_VIEWS["weekly_revenue_variance"]})
_reg("sink_invoices", lambda t: _sink_typed(t, "invoices", K.write_invoices),
     {"sink_invoices": ORACLE_SOURCES["table_invoices"]})
_reg("sink_rates", lambda t: _sink_typed(t, "exchange_rates", K.write_rates),
     {"sink_rates": ORACLE_SOURCES["table_exchange_rates"]})
_reg("sink_artifacts", _stored_artifacts, {"sink_artifacts": ORACLE_CATALOG["artifact_records"]})
_reg("artifact_integrity", _artifact_integrity, ORACLE_CATALOG)
_reg("sink_audit", _sealed_audit, {"sink_audit": ORACLE_CATALOG["audit_keys"]})
_reg("sink_traces", lambda t: _sink(t, "traces", t.session_traces.columns, lambda root: K.append_telemetry(t.session_traces, root)),
     {"sink_traces": ORACLE_SOURCES["stream_traces"]})

# J: streaming forms (driven with availableNow into the shared checkpoint folder)
from ..streaming import streams as J  # noqa: E402

_reg("stream_traces", lambda t: J.stream_traces(t.spark, t.sf_dir), ORACLE_SOURCES)
_reg("stream_hourly_errors", lambda t: J.stream_hourly_errors(t.spark, t.sf_dir), ORACLE_SOURCES)
_reg("stream_gate_dedup", lambda t: J.stream_gate_dedup(t.spark, t.sf_dir), ORACLE_SOURCES)
_reg("stream_latest_state", lambda t: J.stream_latest_state(t.spark, t.sf_dir), ORACLE_SOURCES)
