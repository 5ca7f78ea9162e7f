"""DuckDB oracle texts for classification/access (H*) and lifecycle (I*)."""

from __future__ import annotations

from ..operators.access import AGENT_KEYWORDS, DIRECT_KEYWORDS, DOMAIN_KEYWORDS
from ..sources.adapters import with_adapters
from .oracle_quality import _list, rule_case
from .oracle_views import ratio

ORACLE: dict[str, str] = {}


def _hits(words):
    return f"len(list_filter({_list(words)}, lambda w: contains(lower(coalesce(brief_text, '')), w)))"


ORACLE["delivery_path"] = with_adapters(["briefs"], f"""
SELECT brief_id, {_hits(DIRECT_KEYWORDS)} AS direct_score, {_hits(AGENT_KEYWORDS)} AS agent_score,
       CASE WHEN {_hits(DIRECT_KEYWORDS)} >= {_hits(AGENT_KEYWORDS)}
                 AND NOT contains(lower(coalesce(brief_text, '')), 'python')
                 AND NOT contains(lower(coalesce(brief_text, '')), 'api')
            THEN 'direct_connector_automation' ELSE 'multi_agent_software_dev' END AS recommended_path
FROM briefs""")

_ROUTE_TEXT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(coalesce(brief_text, '')), '{w}')" for w in words) + f" THEN '{d}'"
    for d, words in DOMAIN_KEYWORDS) + " ELSE 'finance' END"
ROUTE = (f"(CASE WHEN requested_domain IS NOT NULL AND requested_domain <> '' THEN lower(requested_domain) "
         f"ELSE {_ROUTE_TEXT} END)")

ORACLE["domain_route"] = with_adapters(["briefs"], f"SELECT brief_id, {ROUTE} AS domain FROM briefs")

_EFF = (f"(CASE WHEN coalesce(len(roles), 0) <= 0 THEN {rule_case('node_id', 'roles')} ELSE roles END)")
_KNOWN = "(CASE WHEN node_id IN ('finance', 'sales', 'firmware', 'marketing', 'logistics') THEN node_id ELSE 'finance' END)"

ORACLE["access_decision"] = with_adapters(["actors"], f"""
SELECT request_id, node_id, {_KNOWN} AS rules_domain,
       actor_type = 'agent' OR coalesce(list_has_any({_EFF}, ['admin', 'finance_admin']), false)
         OR coalesce(list_has_any({_EFF}, {rule_case('node_id', 'roles')}), false) AS allowed
FROM actors""")

ORACLE["normalize_identity"] = with_adapters(["actors"], f"""
SELECT request_id, actor_type,
       string_split(coalesce(raw_email, 'user@example.com'), ':')[-1] AS user_email,
       CASE WHEN via_proxy THEN 'iap|' || string_split(coalesce(raw_email, 'user@example.com'), ':')[-1]
            ELSE 'google|' || coalesce(raw_email, 'user@example.com') END AS subject_id,
       coalesce(department, upper(left(node_id, 1)) || lower(substr(node_id, 2))) AS department,
       array_to_string({_EFF}, ',') AS roles
FROM actors""")

ORACLE["actor_split"] = with_adapters(["audit_log"], """
SELECT node_id, CASE WHEN starts_with(actor_email, 'sa-agent-') THEN 'agent' ELSE 'human' END AS actor_kind,
       count(*) AS actions
FROM audit_log GROUP BY 1, 2""")

ORACLE["table_allowlist"] = with_adapters(["briefs"], f"""
, r AS (SELECT brief_id, {ROUTE} AS domain, requested_tables FROM briefs),
b AS (SELECT brief_id, domain, list_filter(requested_tables, lambda t: NOT list_contains({rule_case('domain', 'tables')}, t)) AS bad
      FROM r)
SELECT brief_id, domain, len(bad) AS denied_tables, array_to_string(bad, ',') AS tables FROM b""")

ORACLE["default_roles"] = with_adapters(["actors"], f"""
SELECT request_id, node_id, array_to_string({rule_case('node_id', 'roles')}, ',') AS granted_roles
FROM actors WHERE coalesce(len(roles), 0) <= 0""")

# ---------------------------------------------------------------------------
_DEST = ("CASE review_outcome WHEN 'fail_fix' THEN 'IMPLEMENT' WHEN 'fail_design' THEN 'DESIGN' "
         "WHEN 'fail_definition' THEN 'SPECIFY' WHEN 'fail_spec' THEN 'SPECIFY' ELSE 'IMPLEMENT' END")
BUDGET = f"""
, ch AS (SELECT loop_id, event_id, ts, step_name, review_outcome,
               CASE WHEN (step_name = 'SPEC_HARNESS' AND NOT coalesce(harness_passed, false))
                         OR (step_name = 'GATE_H1' AND decision = 'request_changes') THEN 'SPECIFY'
                    WHEN step_name = 'REVIEW' AND coalesce(review_outcome, 'pass') <> 'pass' THEN {_DEST}
                    WHEN step_name = 'GATE_H2' AND decision = 'request_changes' THEN 'IMPLEMENT' END AS destination,
               (step_name = 'SPEC_HARNESS' AND NOT coalesce(harness_passed, false))
                 OR (step_name = 'REVIEW' AND coalesce(review_outcome, 'pass') <> 'pass') AS capped
        FROM loop_events),
cnt AS (SELECT *, count(*) OVER (PARTITION BY loop_id, destination ORDER BY ts, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
        FROM ch WHERE destination IS NOT NULL),
cnt2 AS (SELECT *, cast(coalesce(sum(CASE WHEN capped AND earlier >= 3 THEN 0 ELSE 1 END)
                   OVER (PARTITION BY loop_id, destination ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS charges FROM cnt),
bud AS (SELECT loop_id, event_id, step_name, destination, charges AS charges_before,
               NOT (capped AND earlier >= 3) AS charged, capped AND earlier >= 3 AS escalated,
               CASE WHEN capped AND earlier >= 3 AND step_name = 'SPEC_HARNESS'
                      THEN 'Spec harness validation failed after 3 retries. Violations: ' || (
                        SELECT coalesce(max_by(array_to_string(h.violations, ', '), (h.ts, h.event_id)), 'Unknown violations')
                        FROM harness_reports h WHERE h.loop_id = cnt2.loop_id AND h.ts <= cnt2.ts)
                    WHEN capped AND earlier >= 3
                      THEN 'Reviewer returned ''' || review_outcome || ''' and retry limit (3) for node '''
                           || destination || ''' was reached.' END AS reason
        FROM cnt2),
tr AS (SELECT e.loop_id, e.event_id, e.ts, e.step_name,
              CASE e.step_name WHEN 'INTAKE' THEN 'SPECIFY' WHEN 'SPECIFY' THEN 'SPEC_HARNESS'
                   WHEN 'DESIGN' THEN 'IMPLEMENT' WHEN 'IMPLEMENT' THEN 'REVIEW' WHEN 'CLOSE' THEN 'WATCH'
                   WHEN 'WATCH' THEN 'DONE'
                   WHEN 'SPEC_HARNESS' THEN CASE WHEN coalesce(e.harness_passed, false) THEN 'GATE_H1'
                                                 WHEN coalesce(b.escalated, false) THEN 'ESCALATED' ELSE 'SPECIFY' END
                   WHEN 'GATE_H1' THEN CASE WHEN e.decision IS NULL THEN 'WAIT_GATE_H1' WHEN e.decision = 'approve' THEN 'DESIGN'
                                            WHEN e.decision = 'request_changes' THEN 'SPECIFY' ELSE 'CLOSED' END
                   WHEN 'REVIEW' THEN CASE WHEN coalesce(e.review_outcome, 'pass') = 'pass' THEN 'GATE_H2'
                                           WHEN coalesce(b.escalated, false) THEN 'ESCALATED'
                                           ELSE {_DEST.replace('review_outcome', 'e.review_outcome')} END
                   WHEN 'GATE_H2' THEN CASE WHEN e.decision IS NULL THEN 'WAIT_GATE_H2' WHEN e.decision = 'approve' THEN 'CLOSE'
                                            WHEN e.decision = 'request_changes' THEN 'REVIEW' ELSE 'CLOSED' END
                   ELSE e.step_name END AS next_state,
              CASE WHEN e.step_name = 'GATE_H1' AND e.decision NOT IN ('approve', 'request_changes')
                     THEN 'Gate H1 rejected by human reviewer (' || e.reviewer || ').'
                   WHEN e.step_name = 'GATE_H2' AND e.decision NOT IN ('approve', 'request_changes')
                     THEN 'Gate H2 rejected by human reviewer (' || e.reviewer || ').'
                   WHEN b.escalated THEN b.reason END AS reason
       FROM loop_events e LEFT JOIN bud b ON e.event_id = b.event_id),
latest AS (SELECT loop_id, current_state, updated_at FROM
           (SELECT loop_id, next_state AS current_state, ts AS updated_at,
                   row_number() OVER (PARTITION BY loop_id ORDER BY ts DESC, event_id DESC) AS rn FROM tr) x
           WHERE rn = 1)"""

_LE = ["loop_events", "harness_reports"]
ORACLE["retry_budget"] = with_adapters(_LE, BUDGET + "\nSELECT * FROM bud")
ORACLE["total_retries"] = with_adapters(_LE, BUDGET + """
SELECT loop_id, count(*) FILTER (WHERE charged) AS total_retries FROM bud GROUP BY loop_id""")
ORACLE["next_state"] = with_adapters(_LE, BUDGET + "\nSELECT * FROM tr")
ORACLE["latest_loop_state"] = with_adapters(_LE, BUDGET + "\nSELECT * FROM latest")
ORACLE["pending_gates"] = with_adapters(_LE, BUDGET + f"""
SELECT loop_id, current_state,
       CASE WHEN current_state IN ('WAIT_GATE_H1', 'WAIT_GATE_H2') THEN 'PENDING_GATE'
            WHEN current_state IN ('DONE', 'CLOSED', 'ESCALATED') THEN 'TERMINAL' ELSE 'ACTIVE' END AS category,
       CASE WHEN current_state IN ('WAIT_GATE_H1', 'WAIT_GATE_H2') THEN
         {ratio('(epoch_us((SELECT max(updated_at) FROM latest)) - epoch_us(updated_at))', '3600000000', 0, 100)} / 100
       END AS age_hours
FROM latest""")
ORACLE["step_limit"] = with_adapters(_LE, BUDGET + """
, seg AS (SELECT loop_id, coalesce(sum(CASE WHEN next_state IN ('WAIT_GATE_H1', 'WAIT_GATE_H2', 'DONE', 'CLOSED', 'ESCALATED')
                                           THEN 1 ELSE 0 END)
                                  OVER (PARTITION BY loop_id ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
         FROM tr)
SELECT loop_id, cast(segment AS bigint) AS segment, count(*) AS steps, count(*) >= 25 AS escalated
FROM seg GROUP BY 1, 2""")
ORACLE["first_gate_resolution"] = with_adapters(_LE, """
SELECT loop_id, event_id, step_name AS gate, decision,
       row_number() OVER (PARTITION BY loop_id, step_name ORDER BY ts, event_id) AS resolution_rank,
       CASE WHEN row_number() OVER (PARTITION BY loop_id, step_name ORDER BY ts, event_id) = 1
            THEN 'EFFECTIVE' ELSE 'CONFLICT' END AS status
FROM loop_events WHERE decision IS NOT NULL""")
ORACLE["stage_durations"] = with_adapters(_LE, f"""
, d AS (SELECT step_name, lead(epoch_us(ts)) OVER (PARTITION BY loop_id ORDER BY ts, event_id) - epoch_us(ts) AS dur_us
       FROM loop_events)
SELECT step_name, count(*) AS transitions, {ratio('sum(dur_us)', 'count(*)', 0)} / 1e6 AS avg_seconds,
       cast(max(dur_us) AS double) / 1e6 AS max_seconds
FROM d WHERE dur_us IS NOT NULL GROUP BY step_name""")
