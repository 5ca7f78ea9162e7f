"""DuckDB oracle texts for the catalog / audit / telemetry queries (E*)."""

from __future__ import annotations

from ..sources.adapters import payload_text, with_adapters
from .oracle_views import avg_exact, ratio

ORACLE: dict[str, str] = {}

_RECORDS = """
, rec AS (SELECT 'ART-' || upper(domain) || '-' || right(loop_id, 8) || '-' || replace(artifact_name, '.', '_')
                  AS artifact_id,
                loop_id, domain, artifact_name,
                CASE WHEN suffix(artifact_name, '.sql') THEN 'SQL_VIEW'
                     WHEN artifact_name = 'spec.md' THEN 'SPECIFICATION'
                     WHEN artifact_name = 'test_results.json' THEN 'TEST_REPORT'
                     ELSE 'PYTHON_CODE' END AS artifact_type,
                'gs://analytics-artifacts/processes/' || domain || '/' || loop_id || '/' || artifact_name AS gcs_uri,
                sha256(content) AS content_sha256,
                cast(strlen(content) AS bigint) AS size_bytes,
                created_at, 'delivery-engine' AS created_by
         FROM artifacts)"""

ORACLE["artifact_records"] = with_adapters(["artifacts"], _RECORDS + "\nSELECT * FROM rec")

ORACLE["artifacts_for_loop"] = with_adapters(["artifacts", "test_results"], _RECORDS + """
SELECT * FROM rec WHERE loop_id IN
  (SELECT '01KZZ' || lpad(cast(run_id AS string), 14, '0') FROM test_results WHERE NOT passed)""")

ORACLE["artifacts_by_domain"] = with_adapters(["artifacts"], _RECORDS + """
SELECT domain, artifact_type, count(*) AS artifacts, sum(size_bytes) AS total_bytes
FROM rec GROUP BY domain, artifact_type""")

ORACLE["recent_artifacts"] = with_adapters(["artifacts"], _RECORDS + """
SELECT artifact_id, domain, loop_id, artifact_name, artifact_type, gcs_uri, content_sha256, created_at
FROM rec ORDER BY created_at DESC, artifact_id DESC LIMIT 20""")

ORACLE["recent_traces"] = with_adapters(["session_traces"], """
SELECT loop_id AS session_id, node_id, step_name, duration_ms, input_tokens + output_tokens AS total_tokens,
       status, ts AS "timestamp"
FROM session_traces ORDER BY ts DESC, event_id DESC LIMIT 20""")

ORACLE["gate_audit"] = with_adapters(["session_traces"], """
SELECT loop_id AS session_id, node_id, step_name, status, ts AS "timestamp"
FROM session_traces ORDER BY ts DESC, event_id DESC LIMIT 50""")

ORACLE["events_for_loop"] = with_adapters(["session_traces"], """
SELECT loop_id, event_id, step_name, ts,
       row_number() OVER (PARTITION BY loop_id ORDER BY ts, event_id) AS arrival_seq
FROM session_traces""")

ORACLE["health_30d"] = with_adapters(["session_traces"], f"""
, g AS (SELECT node_id, count(*) AS executions,
              {avg_exact('duration_ms', 3)} AS avg_latency_ms,
              count(*) FILTER (WHERE status = 'FAILED') AS failed
       FROM session_traces
       WHERE ts > (SELECT max(ts) FROM session_traces) - INTERVAL 30 DAY
       GROUP BY node_id),
h AS (SELECT node_id, executions, avg_latency_ms,
             {ratio('failed', 'executions', 2, 100)} AS error_rate_pct FROM g)
SELECT *, avg_latency_ms < 250.0 AND error_rate_pct <= 0.1 AS sla_conformance,
       CASE WHEN avg_latency_ms < 250.0 AND error_rate_pct <= 0.1 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status
FROM h""")

_BS = "chr(92)"
_CANON = payload_text(
    "payload.loop_id", "payload.labels[1]", "payload.step", "payload.seq", "payload.share", "payload.actor.type", "payload.actor.email",
    f"replace(replace(payload.labels[2], 'Ü', {_BS} || 'u00dc'), '→', {_BS} || 'u2192')",
    f"coalesce('\"' || replace(replace(replace(replace(payload.note, {_BS}, {_BS} || {_BS}), '\"', {_BS} || '\"'), chr(10), {_BS} || 'n'), "
    f"chr(9), {_BS} || 't') || '\"', 'null')").replace("{{", "{").replace("}}", "}")

ORACLE["audit_hash"] = with_adapters(["audit_events"], f"""
SELECT loop_id, seq, sha256({_CANON}) AS state_snapshot_hash FROM audit_events""")

ORACLE["audit_keys"] = with_adapters(["audit_events"], """
SELECT loop_id, seq, 'EVT-' || left(loop_id, 8) || '-' || printf('%04d', seq) AS event_id,
       'audit/' || node_id || '/' || loop_id || '/' || printf('%08d', seq) || '/'
         || 'EVT-' || left(loop_id, 8) || '-' || printf('%04d', seq) || '.json' AS object_key
FROM audit_events""")

ORACLE["audit_records"] = with_adapters(["audit_events"], f"""
, r AS (SELECT *, {_CANON} AS canon, 'EVT-' || left(loop_id, 8) || '-' || printf('%04d', seq) AS event_id FROM audit_events)
SELECT loop_id, seq, 'audit/' || node_id || '/' || loop_id || '/' || printf('%08d', seq) || '/' || event_id || '.json' AS object_key,
       sha256('{{"actor_email": "' || actor_email || '", "actor_type": "' || actor_type || '", "event_id": "' || event_id
         || '", "intent_kind": "' || intent_kind || '", "loop_id": "' || loop_id || '", "node_id": "' || node_id
         || '", "payload_summary": ' || canon || ', "seq": ' || seq || ', "state_snapshot_hash": "' || sha256(canon)
         || '", "timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}}') AS record_sha256
FROM r""")

ORACLE["artifact_integrity"] = with_adapters(["artifacts", "stored_artifacts", "audit_log"], """
, c AS (SELECT loop_id, artifact_name, count(*) AS copies, min(sha256(content)) AS s1, max(sha256(content)) AS s2,
              min(domain || '/' || strftime(created_at, '%Y-%m-%d')) AS f1, max(domain || '/' || strftime(created_at, '%Y-%m-%d')) AS f2
       FROM stored_artifacts GROUP BY 1, 2),
r AS (SELECT loop_id, artifact_name, domain, sha256(content) AS sha, domain || '/' || strftime(created_at, '%Y-%m-%d') AS place,
             CASE artifact_name WHEN 'spec.md' THEN 'SPECIFY' WHEN 'test_results.json' THEN 'REVIEW' ELSE 'IMPLEMENT' END AS step
      FROM artifacts),
j AS (SELECT coalesce(r.loop_id, c.loop_id) AS loop_id, coalesce(r.artifact_name, c.artifact_name) AS artifact_name, r.domain,
             coalesce(c.copies, 0) AS copies, c.copies IS NULL AS lost, r.sha IS NULL AS uncatalogued,
             coalesce(c.s1 <> r.sha OR c.s2 <> r.sha, false) AS edited, coalesce(c.f1 <> r.place OR c.f2 <> r.place, false) AS moved,
             coalesce(c.copies > 1, false) AS repeated,
             r.step IS NOT NULL AND EXISTS (SELECT 1 FROM audit_log a WHERE a.loop_id = r.loop_id)
               AND NOT EXISTS (SELECT 1 FROM audit_log a WHERE a.loop_id = r.loop_id AND a.step_name = r.step) AS unaudited
      FROM r FULL JOIN c ON r.loop_id = c.loop_id AND r.artifact_name = c.artifact_name)
SELECT * FROM j WHERE lost OR uncatalogued OR edited OR moved OR repeated OR unaudited""")

ORACLE["audit_integrity"] = with_adapters(["audit_events"], f"""
, g AS (SELECT loop_id, count(*) AS records, count(DISTINCT seq) AS d, max(seq) AS mx,
              count(*) FILTER (WHERE sha256({_CANON}) <> stored_hash) AS hash_mismatches
       FROM audit_events GROUP BY loop_id)
SELECT loop_id, records, hash_mismatches, mx - d AS missing_seq, records - d AS repeated_seq
FROM g WHERE mx - d > 0 OR records - d > 0 OR hash_mismatches > 0""")

ORACLE["id_collisions"] = with_adapters(["audit_events", "artifacts"], """
, ids AS (SELECT 'event_id' AS id_kind, 'EVT-' || left(loop_id, 8) || '-' || printf('%04d', seq) AS derived_id, loop_id
         FROM audit_events
         UNION ALL
         SELECT 'artifact_id', 'ART-' || upper(domain) || '-' || right(loop_id, 8) || '-'
                || replace(artifact_name, '.', '_'), loop_id FROM artifacts)
SELECT id_kind, derived_id, count(DISTINCT loop_id) AS loops FROM ids GROUP BY 1, 2
HAVING count(DISTINCT loop_id) > 1""")

ORACLE["token_cost"] = with_adapters(["session_traces"], """
SELECT node_id, loop_id, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
       cast(sum(input_tokens) * 75 + sum(output_tokens) * 300 AS double) / 1e9 AS cost_usd
FROM session_traces GROUP BY node_id, loop_id""")

ORACLE["span_stats"] = with_adapters(["session_traces"], f"""
SELECT 'pipeline.node.' || lower(step_name) AS span_name, count(*) AS spans,
       {avg_exact('duration_ms', 2)} AS avg_ms,
       round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms
FROM session_traces GROUP BY 1""")

ORACLE["span_rows"] = with_adapters(["session_traces"], """
, s AS (SELECT 'pipeline.node.' || lower(step_name) AS span_name, loop_id, duration_ms,
              map_concat(map(['run.loop_id', 'run.node_name', 'gen_ai.system', 'gen_ai.request.model'],
                             [loop_id, step_name, 'model-provider', 'default-model']),
                         map(['gen_ai.request.model', 'status'], [model_name, status])) AS a
       FROM session_traces)
SELECT span_name, loop_id, duration_ms,
       array_to_string(list_transform(list_sort(map_keys(a)), lambda k: k || '=' || map_extract_value(a, k)), ';')
         AS attributes
FROM s""")
