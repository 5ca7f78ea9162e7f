"""Adapters: driver tables -> reference-shaped domain tables.

Each adapter is ONE SQL text that runs unchanged in Spark SQL and in DuckDB
(the oracle), apart from the few functions whose names differ; those go
through a :class:`Dialect`.  Table references are ``{name}`` placeholders:
Spark binds them to DataFrames (``spark.sql(text, **frames)``), DuckDB to
views / CTE names.  Literal braces are doubled.

Every adapter is a projection/filter (or one group-by for ``inventory``)
over a whole driver table, so its cost grows linearly with the data and
Catalyst prunes columns and pushes filters into the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def sha256(self, expr: str) -> str:
        return f"sha2({expr}, 256)" if self.name == "spark" else f"sha256({expr})"

    def str_array(self, *items: str) -> str:
        if not items:
            return "cast(array() as array<string>)" if self.name == "spark" else "cast([] as varchar[])"
        body = ", ".join(f"'{i}'" for i in items)
        return f"array({body})" if self.name == "spark" else f"[{body}]"

    def str_map(self, pairs: list[tuple[str, str]]) -> str:
        """map<string,string> from (literal key, value expression) pairs."""
        if self.name == "spark":
            return "map(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")"
        keys = ", ".join(f"'{k}'" for k, _ in pairs)
        vals = ", ".join(v for _, v in pairs)
        return f"map([{keys}], [{vals}])"

    def struct(self, pairs: list[tuple[str, str]]) -> str:
        """Struct from (literal name, value expression) pairs."""
        if self.name == "spark":
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")"
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in pairs) + ")"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"

    def ts_from_epoch_seconds(self, expr: str) -> str:
        if self.name == "spark":  # zone-free: seconds after the NTZ epoch
            return f"timestampadd(SECOND, {expr}, TIMESTAMP_NTZ '1970-01-01 00:00:00')"
        return f"make_timestamp(cast({expr} AS bigint) * 1000000)"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")

# Driver tables (parquet files under the scale-factor folder).
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# ---------------------------------------------------------------------------
# Fixed values shared with the reference (its process graph, domains, seed).
# ---------------------------------------------------------------------------
# The 11 states of the delivery process, in graph order.
PROCESS_STATES = [
    "INTAKE", "SPECIFY", "SPEC_HARNESS", "GATE_H1", "DESIGN", "IMPLEMENT",
    "REVIEW", "GATE_H2", "CLOSE", "WATCH", "DONE",
]
# Business domains, in the order used to spread fixture rows over them.
DOMAINS = ["finance", "sales", "firmware", "marketing", "logistics"]
# Per-domain mandatory metric besides target_sla_seconds / baseline_error_rate.
DOMAIN_METRIC = {
    "finance": "reconciliation_variance_tolerance_pct",
    "sales": "conversion_variance_pct",
    "firmware": "telemetry_ingestion_delay_ms",
    "marketing": "cac_calculation_variance_pct",
    "logistics": "dispatch_sla_adherence_pct",
}
# Required test types per domain (acceptance criteria).
REQUIRED_TEST_TYPES = {
    "finance": ["unit", "sql_syntax_lint", "null_value_boundary", "currency_precision_check"],
    "sales": ["unit", "sql_syntax_lint", "pii_masking_check"],
    "firmware": ["unit", "telemetry_schema_validation", "ocpp_compliance_check"],
    "marketing": ["unit", "sql_syntax_lint", "gdpr_cookie_consent_filter_check"],
    "logistics": ["unit", "sql_syntax_lint", "dispatch_sla_check"],
}
# Seed exchange rates (rate_date, base, target, rate).
SEED_RATES = [
    ("2026-08-01", "EUR", "USD", "1.0850"),
    ("2026-08-01", "EUR", "GBP", "0.8540"),
    ("2026-08-02", "EUR", "USD", "1.0865"),
    ("2026-08-03", "EUR", "GBP", "0.8530"),
]
# Opening phrases of fixture briefs (our own text; they carry the keywords of
# the delivery-path and domain rules, "Rapid" contains "api").
BRIEF_OPENINGS = [
    "Build a weekly revenue variance report dashboard for currency reconciliation. ",
    "Create a Python API endpoint that serves charger firmware telemetry. ",
    "Rapid aggregate view of campaign attribution and CAC per channel. ",
    "Pull data to extract warehouse inventory and dispatch SLA figures. ",
    "Custom script with a webhook and an algorithm for the sales pipeline in the CRM. ",
    "Query the invoice variance view for the finance team. ",
]

K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
# Events with the props number extracted once per row (referenced as ``k``).
EVENTS_K = f"(SELECT *, {K} AS k FROM {{events}}) AS e"
NL = "chr(10)"


def _case_mod(expr: str, n: int, values: list[str], quote: bool = True) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {repr(v) if quote else v}" for i, v in enumerate(values)
    )
    return f"CASE {expr} % {n} {arms} END"


def _domain_of(expr: str) -> str:
    return _case_mod(expr, 5, DOMAINS)


def _state_of(expr: str) -> str:
    return _case_mod(expr, 11, PROCESS_STATES)


# ---------------------------------------------------------------------------
# Adapter texts.  name -> (dependencies, builder(dialect) -> sql)
# ---------------------------------------------------------------------------

def _invoices(d: Dialect) -> str:
    return f"""
SELECT o_orderkey AS invoice_id,
       o_custkey AS account_id,
       cast(o_totalprice AS decimal(18,2)) AS amount,
       {_case_mod('o_orderkey', 3, ['EUR', 'USD', 'GBP'])} AS currency,
       CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'PENDING' ELSE 'OVERDUE' END AS status,
       cast(o_orderdate AS date) AS issue_date,
       cast(o_orderdate AS date) + 14 AS due_date
FROM {{orders}}"""


def _exchange_rates(d: Dialect) -> str:
    # EUR rates derived from the data: one rate per (year with orders,
    # target currency), moving around the first seed rate of the currency in
    # steps of 0.0300 (USD) / 0.0250 (GBP) with the year, so some weeks drift
    # past the 5 % reconciliation tolerance.  B1 joins on the currency only,
    # so every PAID non-EUR invoice fans out over the yearly rates.
    years = "(SELECT DISTINCT cast(year(o_orderdate) AS int) AS y FROM {orders})"
    return f"""
SELECT make_date(y, 1, 1) AS rate_date, 'EUR' AS base_currency, 'USD' AS target_currency,
       cast(1.0850 + 0.0300 * (y % 5 - 2) AS double) AS rate
FROM {years} AS yu
UNION ALL
SELECT make_date(y, 1, 1) AS rate_date, 'EUR' AS base_currency, 'GBP' AS target_currency,
       cast(0.8540 + 0.0250 * (y % 5 - 2) AS double) AS rate
FROM {years} AS yg"""


def _exchange_rate_history(d: Dialect) -> str:
    # The as-of views (B6, C9) read the same yearly rates.
    return "SELECT * FROM {exchange_rates}"


def _billing_events(d: Dialect) -> str:
    return """
SELECT event_id, user_id % 40 AS account_id, user_id AS charger_id,
       value AS kwh_consumed, ts AS event_timestamp
FROM {events} WHERE event_type <> 'error'"""


def _opportunities(d: Dialect) -> str:
    stage = ("CASE left(o_orderpriority, 1) WHEN '1' THEN 'Won' WHEN '2' THEN 'Negotiation' "
             "WHEN '3' THEN 'Qualified' WHEN '4' THEN 'Prospecting' ELSE 'Lost' END")
    return f"""
SELECT o_orderkey AS opp_id, c_name AS account_name,
       cast(o_totalprice AS decimal(18,2)) AS amount_eur,
       {stage} AS stage,
       cast(o_orderdate AS date) AS close_date
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey"""


def _accounts(d: Dialect) -> str:
    return """
SELECT c_custkey AS account_id, r_name AS region,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Enterprise'
            WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Commercial' ELSE 'SMB' END AS tier
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey"""


def _lead_conversions(d: Dialect) -> str:
    return """
SELECT event_id AS lead_id,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS converted_flag,
       ts AS conversion_timestamp
FROM {events} WHERE event_type IN ('signup', 'purchase')"""


def _charger_telemetry(d: Dialect) -> str:
    return f"""
SELECT event_id AS reading_id, user_id AS charger_id,
       '5.14.' || cast(k % 4 AS string) AS firmware_version,
       220.0 + value % 20.0 AS voltage,
       value % 32.0 AS current_amperes,
       20.0 + value % 80.0 AS temperature_celsius,
       ts AS event_timestamp
FROM {EVENTS_K}"""


def _firmware_releases(d: Dialect) -> str:
    # Releases seen in the telemetry: one row per firmware version, released
    # on the first day it reports; status by patch number.
    status = "CASE right(version, 1) WHEN '0' THEN 'DEPRECATED' WHEN '3' THEN 'STAGING' ELSE 'GA' END"
    return f"""
SELECT 'REL-' || version AS release_id, version, release_date, {status} AS status
FROM (SELECT '5.14.' || cast(k % 4 AS string) AS version, min(cast(ts AS date)) AS release_date
      FROM {EVENTS_K} GROUP BY 1) AS v"""


def _error_logs(d: Dialect) -> str:
    return f"""
SELECT event_id AS log_id, user_id AS charger_id,
       'E' || cast(k % 10 AS string) AS error_code,
       CASE WHEN value >= 50 THEN 'CRITICAL' WHEN value >= 20 THEN 'WARNING' ELSE 'INFO' END AS severity,
       ts AS log_timestamp
FROM {EVENTS_K} WHERE event_type = 'error'"""


def _campaign_events(d: Dialect) -> str:
    return f"""
SELECT event_id, k % 50 AS campaign_id,
       {_case_mod(f'(k % 50)', 3, ['Search', 'Social', 'Affiliate'])} AS channel,
       user_id,
       {d.sha256('cast(user_id AS string)')} AS user_id_hashed,
       CASE event_type WHEN 'purchase' THEN 'Purchase' WHEN 'signup' THEN 'Signup'
                       WHEN 'click' THEN 'Click' ELSE 'Impression' END AS event_type,
       user_id % 4 <> 0 AS consent_granted,
       ts AS event_timestamp
FROM {EVENTS_K} WHERE event_type <> 'error'"""


def _user_acquisitions(d: Dialect) -> str:
    return f"""
SELECT event_id AS acquisition_id, k % 50 AS campaign_id,
       cast(value AS decimal(18,2)) AS cac_usd, ts AS converted_at
FROM {EVENTS_K} WHERE event_type = 'signup'"""


def _ad_spend(d: Dialect) -> str:
    return """
SELECT l_orderkey * 10 + l_linenumber AS spend_id,
       CASE l_returnflag WHEN 'A' THEN 'Search' WHEN 'N' THEN 'Social' ELSE 'Affiliate' END AS channel,
       cast(l_extendedprice AS decimal(18,2)) AS amount_usd,
       cast(l_shipdate AS date) AS spend_date
FROM {lineitem}"""


def _campaign_spend(d: Dialect) -> str:
    # The spend on days of the campaign month; a channel rests one day in nine.
    return """
SELECT l_orderkey * 10 + l_linenumber AS spend_id,
       CASE l_returnflag WHEN 'A' THEN 'Search' WHEN 'N' THEN 'Social' ELSE 'Affiliate' END AS channel,
       cast(l_extendedprice AS decimal(18,2)) AS amount_usd,
       cast('2024-01-01' AS date) + cast(l_orderkey % 40 AS int) AS spend_date
FROM {lineitem} WHERE l_orderkey % 9 <> 4"""


def _inventory(d: Dialect) -> str:
    return """
SELECT l_partkey AS part_id, l_suppkey AS warehouse_id,
       cast(sum(l_quantity) AS bigint) AS quantity_on_hand,
       cast(max(p_size) * 10 AS bigint) AS reorder_point,
       max(l_shipdate) AS last_updated
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
GROUP BY l_partkey, l_suppkey"""


def _warehouse_dispatch(d: Dialect) -> str:
    return """
SELECT l_orderkey * 10 + l_linenumber AS dispatch_id, l_orderkey AS order_id,
       l_suppkey AS warehouse_id, l_quantity AS dispatch_time_hours, 24.0 AS sla_target_hours,
       CASE WHEN l_quantity <= 24.0 THEN 'ON_TIME' ELSE 'DELAYED' END AS status
FROM {lineitem}"""


def _parts_catalog(d: Dialect) -> str:
    return """
SELECT p_partkey AS part_id, p_name AS part_name, p_type AS category,
       cast(p_retailprice AS decimal(18,2)) AS unit_cost_eur
FROM {part}"""


def _session_traces(d: Dialect) -> str:
    return f"""
SELECT event_id, '01KZZ' || lpad(cast(user_id AS string), 14, '0') AS loop_id,
       {_domain_of('user_id')} AS node_id,
       {_state_of('k')} AS step_name,
       'model-default' AS model_name,
       cast(k * 10 AS bigint) AS input_tokens,
       cast(k * 4 AS bigint) AS output_tokens,
       value AS duration_ms,
       CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       ts
FROM {EVENTS_K}"""


def _loop_events(d: Dialect) -> str:
    # Gate decisions; every fifth gate event is still unresolved (NULL).
    decision = ("CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'approve' "
                "WHEN 2 THEN 'request_changes' WHEN 3 THEN 'reject' END")
    outcome = _case_mod("event_id", 6, ["pass", "pass", "fail_fix", "fail_design", "fail_definition", "fail_spec"])
    return f"""
SELECT event_id, loop_id, node_id, step_name, ts,
       CASE WHEN step_name IN ('GATE_H1', 'GATE_H2') THEN {decision} END AS decision,
       CASE WHEN step_name = 'REVIEW' THEN {outcome} END AS review_outcome,
       CASE WHEN step_name = 'SPEC_HARNESS' THEN event_id % 3 <> 0 END AS harness_passed,
       CASE WHEN step_name IN ('GATE_H1', 'GATE_H2') THEN 'reviewer' || right(loop_id, 3) || '@example.com' END AS reviewer
FROM {{session_traces}}"""


# Columns of an audit record that need no numbering.
_AUDITED = """event_id AS trace_event_id, loop_id, node_id, step_name, ts,
       CASE WHEN step_name IN ('GATE_H1', 'GATE_H2') THEN 'human' ELSE 'agent' END AS actor_type,
       CASE WHEN step_name IN ('GATE_H1', 'GATE_H2') THEN 'reviewer' || right(loop_id, 3) || '@example.com'
            ELSE 'sa-agent-' || node_id || '@agents.example.com' END AS actor_email,
       'STATE_TRANSITION' AS intent_kind"""


def _harness_reports(d: Dialect) -> str:
    # What the harness said of a loop's specification, each time it was written.
    lists = [[], ["Specification content is empty."], ["Missing mandatory Gherkin keyword Then."],
             ["Missing required frontmatter field created_at.", "Missing mandatory Gherkin keyword Given."]]
    arms = " ".join(f"WHEN {i} THEN {d.str_array(*[v for v in vs])}" for i, vs in enumerate(lists))
    return f"""
SELECT event_id, loop_id, ts, CASE event_id % 4 {arms} END AS violations
FROM {{session_traces}} WHERE step_name = 'SPECIFY'"""


def _audit_log(d: Dialect) -> str:
    """The audit log without sequence numbers."""
    return f"""
SELECT {_AUDITED} FROM {{session_traces}} WHERE event_id % 53 <> 0"""


_ESC = "chr(92)"  # a backslash, which the two engines' literals treat differently


def payload_text(loop_id: str, node: str, step: str, seq: str, share: str, kind: str, email: str, label: str, note: str) -> str:
    """SQL of the canonical JSON of an audit payload, from the SQL of its
    values (``label`` and ``note`` already escaped, ``note`` with its quotes)."""
    return (f"'{{{{\"actor\": {{{{\"email\": \"' || {email} || '\", \"type\": \"' || {kind} || '\"}}}}, \"attrs\": {{{{\"intent\": "
            f"\"STATE_TRANSITION\", \"node\": \"' || {node} || '\"}}}}, \"gate\": ' || CASE WHEN {kind} = 'human' THEN 'true' ELSE 'false' END"
            f" || ', \"labels\": [\"' || {node} || '\", \"' || {label} || '\"], \"loop_id\": \"' || {loop_id} || '\", \"note\": ' || {note}"
            f" || ', \"seq\": ' || cast({seq} AS string) || ', \"share\": ' || cast({share} AS string) || ', \"step\": \"' || {step} || '\"}}}}'")


def _audit_events(d: Dialect) -> str:
    # Sealed audit log of the traces with nested payloads.  Fixture defects so
    # that the integrity check has something to find: rows with
    # trace_event_id % 53 = 0 are missing (seq gaps); rows with % 97 = 0 were
    # altered after sealing (payload no longer matches stored_hash).
    share = "cast(seq AS double) / 8"
    original = payload_text("loop_id", "node_id", "step_name", "seq", share, "actor_type", "actor_email",
                            f"{_ESC} || 'u00dcbergang ' || {_ESC} || 'u2192 ' || step_name",
                            f"CASE WHEN seq % 7 = 0 THEN '\"line' || {_ESC} || 'ntab' || {_ESC} || 't' || {_ESC} || '\"end' || {_ESC} || '\"\"' "
                            "ELSE 'null' END")
    payload = d.struct([
        ("loop_id", "loop_id"), ("step", "CASE WHEN trace_event_id % 97 = 0 THEN 'TAMPERED' ELSE step_name END"),
        ("seq", "cast(seq AS bigint)"), ("share", share), ("gate", "actor_type = 'human'"),
        ("actor", d.struct([("type", "actor_type"), ("email", "actor_email")])),
        ("labels", d.array("node_id", "'Übergang → ' || step_name")),
        ("note", "CASE WHEN seq % 7 = 0 THEN 'line' || chr(10) || 'tab' || chr(9) || '\"end\"' END"),
        ("attrs", d.str_map([("node", "node_id"), ("intent", "intent_kind")]))])
    return f"""
SELECT trace_event_id, loop_id, node_id, step_name, ts, seq, actor_type, actor_email, intent_kind,
       {payload} AS payload,
       {d.sha256(original)} AS stored_hash
FROM (SELECT {_AUDITED}, seq
      FROM {{numbered_traces}}) AS s
WHERE trace_event_id % 53 <> 0"""


def _numbered_traces(d: Dialect) -> str:
    # Traces of a loop numbered in order.  Spark computes the same column in
    # slices (``tables.SLICED``), so that a hot loop is not one task.
    return """
SELECT event_id, loop_id, node_id, step_name, ts, row_number() OVER (PARTITION BY loop_id ORDER BY ts, event_id) AS seq
FROM {session_traces}"""


def _artifacts(d: Dialect) -> str:
    names = ["spec.md", "query.sql", "transform.py", "test_results.json"]
    return f"""
SELECT doc_id, '01KZZ' || lpad(cast(doc_id AS string), 14, '0') AS loop_id,
       {_domain_of('doc_id')} AS domain,
       {_case_mod('doc_id', 4, names)} AS artifact_name,
       CASE WHEN doc_id % 4 = 2 AND doc_id % 3 = 0 THEN 'import os' || {NL} || 'os.system(cmd)' || {NL} || text
            WHEN doc_id % 4 = 2 AND doc_id % 5 = 1 THEN 'value = eval(expr)' || {NL} || '__import__(name)' || {NL} || text
            ELSE text END AS content,
       {d.ts_from_epoch_seconds('1767225600 + doc_id * 60')} AS created_at
FROM {{documents}}"""


def _stored_artifacts(d: Dialect) -> str:
    # What the store holds of the artifacts, with planted defects: lost,
    # altered, moved to another domain, stored twice, never catalogued.
    moved = " ".join(f"WHEN {i} THEN '{DOMAINS[(i + 1) % 5]}'" for i in range(5))
    return f"""
SELECT doc_id, loop_id, CASE WHEN doc_id % 41 = 7 THEN (CASE doc_id % 5 {moved} END) ELSE domain END AS domain,
       CASE WHEN doc_id % 47 = 13 AND copy = 1 THEN 'notes.txt' ELSE artifact_name END AS artifact_name,
       CASE WHEN doc_id % 37 = 3 THEN content || ' ' ELSE content END AS content, created_at
FROM (SELECT *, 0 AS copy FROM {{artifacts}} WHERE doc_id % 31 <> 5
      UNION ALL SELECT *, 1 AS copy FROM {{artifacts}} WHERE doc_id % 43 = 11 OR doc_id % 47 = 13) AS a"""


def _specs(d: Dialect) -> str:
    metric = "CASE doc_id % 5 " + " ".join(
        f"WHEN {i} THEN '{DOMAIN_METRIC[dom]}'" for i, dom in enumerate(DOMAINS)) + " END"
    return f"""
SELECT doc_id, {_domain_of('doc_id')} AS node_id,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE
    '---' || {NL} || CASE WHEN doc_id % 29 = 3 THEN '' ELSE 'id: SPEC-' || cast(doc_id AS string) || {NL} END
    || CASE WHEN doc_id % 29 = 3 THEN '- a list' || {NL} || '- of items' || {NL} || '---' || {NL}
            WHEN doc_id % 31 = 3 THEN 'title: "Specification ' ELSE 'title: Specification ' END || cast(doc_id AS string) || {NL}
    || CASE WHEN doc_id % 23 = 3 THEN chr(9) || 'nested: tab' || {NL} WHEN doc_id % 37 = 3 THEN 'id: again' || {NL}
            WHEN doc_id % 41 = 3 THEN 'owner: team: data' || {NL} WHEN doc_id % 43 = 3 THEN '  deeper: key' || {NL}
            WHEN doc_id % 47 = 3 THEN 'tags: [a, b' || {NL} WHEN doc_id % 53 = 3 THEN 'tags:' || {NL} || '  - a' || {NL} || '  - b' || {NL}
            ELSE '' END
    || 'node_id: ' || {_domain_of('doc_id')} || {NL}
    || CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'created_at: 2026-01-01T00:00:00' || {NL} END
    || 'target_repository: analytics-views' || {NL} || '---' || {NL} END
  || 'Feature: domain view' || {NL}
  || 'Scenario: the view is delivered' || {NL}
  || 'Given the source tables' || {NL}
  || 'When the view runs' || {NL}
  || CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'Then the totals reconcile' || {NL} END
  || CASE WHEN doc_id % 17 = 0 THEN 'drop table x;' || {NL} ELSE '' END
  || '## Business Metrics' || {NL}
  || '- target_sla_seconds: 5.0' || {NL}
  || '- baseline_error_rate: 0.001' || {NL}
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '- ' || {metric} || ': 0.05' || {NL} END
  || CASE WHEN doc_id % 19 = 0 THEN 'password: not-a-secret' || {NL} ELSE '' END
  || text AS text
FROM {{documents}}"""


def _briefs(d: Dialect) -> str:
    from .rules import DOMAIN_RULES
    opening = _case_mod("doc_id", 6, BRIEF_OPENINGS)
    own = " ".join(f"WHEN {i} THEN {d.str_array(*DOMAIN_RULES[dom]['tables'][:2])}" for i, dom in enumerate(DOMAINS))
    # Every ninth brief also asks for a table of the next domain.
    extra = " ".join(
        f"WHEN {i} THEN {d.str_array(*DOMAIN_RULES[dom]['tables'][:2], DOMAIN_RULES[DOMAINS[(i + 1) % 5]]['tables'][0])}"
        for i, dom in enumerate(DOMAINS))
    return f"""
SELECT doc_id AS brief_id,
       CASE WHEN doc_id % 4 = 0 THEN upper({_domain_of('doc_id')}) END AS requested_domain,
       {opening} || text AS brief_text,
       CASE WHEN doc_id % 9 = 0 THEN (CASE doc_id % 5 {extra} END) ELSE (CASE doc_id % 5 {own} END) END
         AS requested_tables
FROM {{documents}}"""


def _test_results(d: Dialect) -> str:
    full = " ".join(
        f"WHEN {i} THEN {d.str_array(*REQUIRED_TEST_TYPES[dom])}" for i, dom in enumerate(DOMAINS))
    short = " ".join(
        f"WHEN {i} THEN {d.str_array(*REQUIRED_TEST_TYPES[dom][:-1])}" for i, dom in enumerate(DOMAINS))
    return f"""
SELECT doc_id AS run_id, {_domain_of('doc_id')} AS node_id,
       CASE WHEN doc_id % 7 < 5 THEN 100.0 WHEN doc_id % 7 = 5 THEN 50.0 ELSE 0.0 END AS pass_rate,
       CASE WHEN doc_id % 7 < 5 THEN 0 ELSE 1 END AS exit_code,
       doc_id % 7 < 5 AS passed,
       CASE WHEN doc_id % 4 = 0 THEN (CASE doc_id % 5 {short} END)
            ELSE (CASE doc_id % 5 {full} END) END AS executed_test_types
FROM {{documents}}"""


def _actors(d: Dialect) -> str:
    roles = (
        f"CASE c_mktsegment WHEN 'BUILDING' THEN {d.str_array('finance_analyst')} "
        f"WHEN 'MACHINERY' THEN {d.str_array('sales_lead', 'commercial_ops')} "
        f"WHEN 'AUTOMOBILE' THEN {d.str_array('firmware_engineer')} "
        f"WHEN 'FURNITURE' THEN {d.str_array('marketing_manager', 'admin')} "
        f"ELSE {d.str_array()} END"
    )
    return f"""
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 10 = 0 THEN 'agent' ELSE 'human' END AS actor_type,
       CASE WHEN c_custkey % 6 = 0 THEN NULL
            ELSE 'accounts.example:user' || cast(c_custkey AS string) || '@example.com' END AS raw_email,
       c_custkey % 2 = 0 AS via_proxy,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS department,
       {roles} AS roles,
       {_domain_of('c_custkey')} AS node_id
FROM {{customer}}"""


def _conversation_turns(d: Dialect) -> str:
    # Some assistant turns carry the tokens the guardrail rule looks for.
    return """
SELECT conv_id, turn, role,
       CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN text || ' Then run pip install reporting-kit.'
            WHEN role = 'assistant' AND (conv_id + turn) % 11 = 0 THEN text || ' Replace <YOUR_PROJECT_ID> first.'
            ELSE text END AS text
FROM {conversations}"""


def _response_log(d: Dialect) -> str:
    return f"""
SELECT event_id AS response_id, cast(user_id AS string) AS bench_id, {_domain_of('user_id')} AS node_id,
       event_id % 2 = 0 AS protocol_ok,
       event_id % 3 <> 0 AS has_artifacts,
       event_id % 5 <> 0 AS correct_domain,
       event_id % 7 <> 0 AS lifecycle_ok
FROM {{events}}"""


ADAPTERS: dict[str, tuple[tuple[str, ...], object]] = {
    "invoices": (("orders",), _invoices),
    "exchange_rates": (("orders",), _exchange_rates),
    "exchange_rate_history": (("exchange_rates",), _exchange_rate_history),
    "billing_events": (("events",), _billing_events),
    "opportunities": (("orders", "customer"), _opportunities),
    "accounts": (("customer", "nation", "region"), _accounts),
    "lead_conversions": (("events",), _lead_conversions),
    "charger_telemetry": (("events",), _charger_telemetry),
    "firmware_releases": (("events",), _firmware_releases),
    "error_logs": (("events",), _error_logs),
    "campaign_events": (("events",), _campaign_events),
    "user_acquisitions": (("events",), _user_acquisitions),
    "ad_spend": (("lineitem",), _ad_spend),
    "campaign_spend": (("lineitem",), _campaign_spend),
    "inventory": (("lineitem", "part"), _inventory),
    "warehouse_dispatch": (("lineitem",), _warehouse_dispatch),
    "parts_catalog": (("part",), _parts_catalog),
    "session_traces": (("events",), _session_traces),
    "loop_events": (("session_traces",), _loop_events),
    "harness_reports": (("session_traces",), _harness_reports),
    "numbered_traces": (("session_traces",), _numbered_traces),
    "audit_log": (("session_traces",), _audit_log),
    "audit_events": (("numbered_traces",), _audit_events),
    "artifacts": (("documents",), _artifacts),
    "stored_artifacts": (("artifacts",), _stored_artifacts),
    "specs": (("documents",), _specs),
    "briefs": (("documents",), _briefs),
    "test_results": (("documents",), _test_results),
    "actors": (("customer",), _actors),
    "response_log": (("events",), _response_log),
    "conversation_turns": (("conversations",), _conversation_turns),
}


def adapter_sql(name: str, dialect: Dialect) -> str:
    return ADAPTERS[name][1](dialect)


def dependencies(name: str) -> tuple[str, ...]:
    return ADAPTERS[name][0]


def with_adapters(names: list[str], body: str) -> str:
    """DuckDB text: ``WITH`` the named adapters (and their adapter deps) + body."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in ADAPTERS:
            return
        for dep in dependencies(n):
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = []
    for n in order:
        text = adapter_sql(n, DUCKDB)
        mapping = {dep: dep for dep in dependencies(n)}
        ctes.append(f"{n} AS ({text.format(**mapping)}\n)")
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
