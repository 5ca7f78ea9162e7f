"""DuckDB oracle texts for run scoring (G*)."""

from __future__ import annotations

from ..sources.adapters import PROCESS_STATES, with_adapters
from .oracle_quality import f5, f6, f7
from .oracle_views import ratio

_POS = "CASE step_name " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(PROCESS_STATES)) + " ELSE 0 END"


def score2(x: str) -> str:
    return f"cast(round(cast({x} AS decimal(10,4)), 2) AS double)"


SESSIONS = f"""
, pos AS (SELECT loop_id, node_id, event_id, ts, step_name, status, {_POS} AS pos FROM session_traces),
m AS (SELECT *, pos > coalesce(max(pos) OVER (PARTITION BY loop_id ORDER BY ts, event_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS matched FROM pos),
lastst AS (SELECT loop_id, step_name AS final_state FROM
           (SELECT loop_id, step_name, row_number() OVER (PARTITION BY loop_id ORDER BY ts DESC, event_id DESC) AS rn
            FROM session_traces) x WHERE rn = 1),
gd AS (SELECT loop_id, step_name, decision,
              row_number() OVER (PARTITION BY loop_id, step_name ORDER BY ts, event_id) AS rn
       FROM loop_events WHERE decision IS NOT NULL),
gp AS (SELECT loop_id, max(CASE WHEN step_name = 'GATE_H1' THEN decision END) AS h1,
              max(CASE WHEN step_name = 'GATE_H2' THEN decision END) AS h2
       FROM gd WHERE rn = 1 GROUP BY loop_id),
agg AS (SELECT loop_id, min(node_id) AS domain, count(*) AS steps, count(*) FILTER (WHERE matched) AS matched_steps,
               count(*) FILTER (WHERE status IN ('FAILED', 'ERROR')) AS failed_tools,
               min(ts) AS started_at, max(ts) AS ended_at
        FROM m GROUP BY loop_id),
sess AS (SELECT a.loop_id, a.domain, a.steps, a.matched_steps, l.final_state, a.failed_tools, a.started_at, a.ended_at,
                coalesce(g.h1 = 'approve', false) AS h1_approved, coalesce(g.h2 = 'approve', false) AS h2_approved
         FROM agg a JOIN lastst l ON a.loop_id = l.loop_id LEFT JOIN gp g ON a.loop_id = g.loop_id)"""

_GUARD = "['python3 deploy_view.py', '<YOUR_PROJECT_ID>', 'pip install', 'gcloud ']"

REPORT = SESSIONS + f""",
fo AS (SELECT conv_id, arg_max(text, turn) AS final_output FROM conversation_turns WHERE role = 'assistant' GROUP BY conv_id),
base AS (SELECT s.loop_id, s.domain,
                CASE WHEN s.final_state = 'DONE' AND s.h1_approved AND s.h2_approved THEN 1.0 ELSE 0.0 END::double
                  AS task_success,
                {ratio('s.matched_steps', 's.steps', 2)} AS trajectory_quality,
                CASE WHEN s.failed_tools = 0 THEN 1.0 ELSE {score2('greatest(0, 1 - 0.3 * s.failed_tools)')} END
                  AS tool_use_quality,
                CASE WHEN len(list_filter({_GUARD}, lambda p: contains(coalesce(fo.final_output, ''), p))) > 0
                     THEN 0.0 ELSE 1.0 END::double AS instruction_following
         FROM sess s LEFT JOIN fo ON cast(substr(s.loop_id, 6) AS bigint) = fo.conv_id),
rep AS (SELECT *, {score2('0.35 * cast(task_success AS decimal(10,4)) + 0.25 * cast(trajectory_quality AS decimal(10,4)) + 0.20 * cast(tool_use_quality AS decimal(10,4)) + 0.20 * cast(instruction_following AS decimal(10,4))')}
                AS aggregate_score FROM base),
rep2 AS (SELECT *, aggregate_score >= 0.85 AS passed,
                CASE WHEN aggregate_score < 0.85 THEN
                  CASE WHEN task_success = 0 THEN 'GATE_APPROVAL_TIMEOUT_OR_REJECTION'
                       WHEN trajectory_quality < 0.85 THEN 'GRAPH_ROUTING_ANOMALY'
                       WHEN tool_use_quality < 0.85 THEN 'TOOL_EXECUTION_FAILURE'
                       WHEN instruction_following < 0.85 THEN 'NON_TECHNICAL_GUARDRAIL_VIOLATION' END
                END AS loss_cluster,
                printf('Flywheel Quality Index: %.1f%% [TaskSuccess: %.2f, Trajectory: %.2f, ToolUse: %.2f, InstructionFollowing: %.2f]',
                       aggregate_score * 100, task_success, trajectory_quality, tool_use_quality, instruction_following)
                  AS rubric_verdict
         FROM rep)"""

_ADAPTERS = ["session_traces", "loop_events", "conversation_turns"]

ORACLE: dict[str, str] = {}
ORACLE["harvest_traces"] = with_adapters(_ADAPTERS, SESSIONS + "\nSELECT * FROM sess")
ORACLE["trajectory_score"] = with_adapters(_ADAPTERS, SESSIONS + f"""
SELECT loop_id, steps, matched_steps, {ratio('matched_steps', 'steps', 2)} AS trajectory_score FROM sess""")
ORACLE["task_success"] = with_adapters(_ADAPTERS, REPORT + "\nSELECT loop_id, task_success FROM rep2")
ORACLE["tool_use_score"] = with_adapters(_ADAPTERS, REPORT + "\nSELECT loop_id, tool_use_quality FROM rep2")
ORACLE["instruction_score"] = with_adapters(_ADAPTERS, REPORT + "\nSELECT loop_id, instruction_following FROM rep2")
ORACLE["flywheel_report"] = with_adapters(_ADAPTERS, REPORT + "\nSELECT * FROM rep2")
ORACLE["loss_clusters"] = with_adapters(_ADAPTERS, REPORT + """
SELECT loss_cluster, count(*) AS sessions FROM rep2 WHERE loss_cluster IS NOT NULL GROUP BY loss_cluster""")
def _spec_scores(t="sp.text", d="sp.node_id"):
    g1 = (f"CASE WHEN {t} IS NULL OR {t} = '' THEN 0.0 WHEN len({f7(t, d)}) = 0 THEN 1.0 "
          f"ELSE {score2(f'1 - least(0.25 * len({f7(t, d)}), 1)')} END")
    rules = f"list_concat({f5(t, d)}, {f6(t, d)})"
    g3 = (f"CASE WHEN {t} IS NULL OR {t} = '' THEN 0.0 WHEN len({rules}) = 0 THEN 1.0 "
          f"ELSE {score2(f'greatest(1 - 0.3 * len({rules}), 0)')} END")
    return g1, g3


_G1, _G3 = _spec_scores()
ORACLE["gherkin_score"] = with_adapters(["specs"], f"""
SELECT doc_id, {_G1.replace('sp.', '')} AS gherkin_score FROM specs""")
ORACLE["skill_score"] = with_adapters(["specs"], f"""
SELECT doc_id, {_G3.replace('sp.', '')} AS skill_score FROM specs""")
_G4 = (f"CASE WHEN tr.pass_rate IS NULL THEN 0.0 WHEN coalesce(tr.exit_code, 1) = 0 AND tr.pass_rate = 100.0 THEN 1.0 "
       f"ELSE {score2('cast(tr.pass_rate AS decimal(10,4)) / 100 * 0.8')} END")
ORACLE["sandbox_score"] = with_adapters(["test_results"], f"""
SELECT run_id, {_G4.replace('tr.', '')} AS sandbox_score FROM test_results""")

_CARDS = f""",
sc AS (SELECT s.loop_id, s.domain, coalesce({_G1}, 0.0) AS gherkin_contract_score, {ratio('s.matched_steps', 's.steps', 2)} AS graph_conformance_score,
              coalesce({_G3}, 0.0) AS skill_compliance_score, {_G4} AS sandbox_reliability_score
       FROM sess s LEFT JOIN specs sp ON cast(substr(s.loop_id, 6) AS bigint) = sp.doc_id
       LEFT JOIN test_results tr ON cast(substr(s.loop_id, 6) AS bigint) = tr.run_id),
sc2 AS (SELECT *, {score2('0.3 * cast(gherkin_contract_score AS decimal(10,4)) + 0.25 * cast(graph_conformance_score AS decimal(10,4)) + 0.25 * cast(skill_compliance_score AS decimal(10,4)) + 0.2 * cast(sandbox_reliability_score AS decimal(10,4))')}
               AS aggregate_score FROM sc)"""
ORACLE["scorecard"] = with_adapters(_ADAPTERS + ["specs", "test_results"], SESSIONS + _CARDS + """
SELECT *, aggregate_score >= 0.85 AS passed,
       printf('Evaluation Quality Index: %.1f%% (Gherkin: %.2f, Graph: %.2f, Skill: %.2f, Sandbox: %.2f)',
              aggregate_score * 100, gherkin_contract_score, graph_conformance_score, skill_compliance_score,
              sandbox_reliability_score) AS summary
FROM sc2""")

_PROTOCOL = f"""
, b AS (SELECT response_id, node_id AS domain,
              CASE WHEN protocol_ok THEN 1.0 ELSE 0.0 END::double AS protocol_score,
              CASE WHEN correct_domain THEN 1.0 ELSE 0.5 END::double AS routing_score,
              CASE WHEN has_artifacts THEN 1.0 ELSE 0.5 END::double AS artifact_score,
              CASE WHEN lifecycle_ok THEN 1.0 ELSE 0.0 END::double AS lifecycle_score
       FROM response_log),
c AS (SELECT *, {score2('0.35 * cast(protocol_score AS decimal(10,4)) + 0.25 * cast(routing_score AS decimal(10,4)) + 0.20 * cast(artifact_score AS decimal(10,4)) + 0.20 * cast(lifecycle_score AS decimal(10,4))')}
               AS aggregate_score FROM b)"""
ORACLE["protocol_scorecard"] = with_adapters(["response_log"], _PROTOCOL + "\nSELECT *, aggregate_score >= 0.85 AS passed FROM c")

ORACLE["suite_summary"] = with_adapters(_ADAPTERS + ["specs", "test_results", "response_log"], REPORT + _CARDS + _PROTOCOL + f"""
, runs AS (SELECT 'delivery' AS suite, domain, aggregate_score, aggregate_score >= 0.85 AS passed FROM sc2
          UNION ALL SELECT 'protocol', domain, aggregate_score, aggregate_score >= 0.85 FROM c
          UNION ALL SELECT 'flywheel', domain, aggregate_score, passed FROM rep2),
every AS (SELECT * FROM runs UNION ALL SELECT suite, 'ALL', aggregate_score, passed FROM runs),
means AS (SELECT suite, domain, count(*) AS runs, bool_and(passed) AS all_passed,
                 {ratio('sum(cast(cast(aggregate_score AS decimal(10,2)) * 100 AS bigint))', 'count(*)', 0)} / 100 AS mean_aggregate_score
          FROM every GROUP BY 1, 2)
SELECT *, mean_aggregate_score >= 0.85 AS gate_passed FROM means""")
