"""DuckDB oracle texts for typed tables / schema catalog (A*) and the
streaming queries (J*, compared with their batch equivalents)."""

from __future__ import annotations

from ..sources.adapters import with_adapters
from ..sources.schemas import CATALOG, CONTEXT_TABLES, DOMAIN_DATASET

_DUCK_TYPES = {"STRING": "varchar", "NUMERIC": "decimal(18,2)", "FLOAT64": "double", "INT64": "bigint",
               "DATE": "date", "TIMESTAMP": "timestamp"}
ORACLE: dict[str, str] = {}

for _ds, _tables in CATALOG.items():
    for _tbl, _cols in _tables.items():
        _sel = ", ".join(f"cast({n} AS {_DUCK_TYPES[t]}) AS {n}" for n, t in _cols)
        ORACLE[f"table_{_tbl}"] = with_adapters([_tbl], f"SELECT {_sel} FROM {_tbl}")

_ALL = [t for tables in CATALOG.values() for t in tables]
_CAT_ROWS = ", ".join(f"('{ds}', '{tbl}', {i + 1}, '{n}', '{t}', 'REQUIRED')"
                      for ds, tables in CATALOG.items() for tbl, cols in tables.items()
                      for i, (n, t) in enumerate(cols))
_COUNTS = " UNION ALL ".join(f"SELECT '{ds}' AS dataset, '{tbl}' AS table_name, count(*) AS num_rows FROM {tbl}"
                             for ds, tables in CATALOG.items() for tbl in tables)
_BASE = f"""
, cat AS (SELECT * FROM (VALUES {_CAT_ROWS}) AS c(dataset, table_name, pos, column_name, data_type, mode)),
cnt AS ({_COUNTS})"""

ORACLE["table_schema"] = with_adapters(_ALL, _BASE + """
SELECT c.*, n.num_rows FROM cat c LEFT JOIN cnt n ON c.dataset = n.dataset AND c.table_name = n.table_name""")
ORACLE["list_tables"] = with_adapters(_ALL, _BASE + """
SELECT c.dataset, c.table_name, count(*) AS columns, max(n.num_rows) AS num_rows
FROM cat c LEFT JOIN cnt n ON c.dataset = n.dataset AND c.table_name = n.table_name GROUP BY 1, 2""")

_TPOS = ", ".join(f"('{ds}', '{tbl}', {i + 1})" for ds, tables in CATALOG.items() for i, tbl in enumerate(tables))
_DOM = ", ".join(f"('{d}', '{ds}')" for d, ds in DOMAIN_DATASET.items())
ORACLE["schema_context"] = with_adapters(_ALL, _BASE + f""",
tpos AS (SELECT * FROM (VALUES {_TPOS}) AS t(dataset, table_name, table_pos)),
dom AS (SELECT * FROM (VALUES {_DOM}) AS d(domain, dataset)),
pt AS (SELECT c.dataset, c.table_name, t.table_pos,
              string_agg(c.column_name || ' (' || c.data_type || ')', ', ' ORDER BY c.pos) AS cols
       FROM cat c JOIN tpos t ON c.dataset = t.dataset AND c.table_name = t.table_name
       WHERE t.table_pos <= {CONTEXT_TABLES} GROUP BY 1, 2, 3),
ln AS (SELECT pt.dataset, pt.table_pos, n.num_rows, 'Table ''' || pt.table_name || ''': ' || pt.cols AS line
       FROM pt JOIN cnt n ON pt.dataset = n.dataset AND pt.table_name = n.table_name),
ctx AS (SELECT dataset, string_agg(line, chr(10) ORDER BY table_pos) AS context, sum(num_rows) AS num_rows
        FROM ln GROUP BY dataset)
SELECT dom.domain, dom.dataset, ctx.context, cast(ctx.num_rows AS bigint) AS num_rows
FROM dom JOIN ctx ON dom.dataset = ctx.dataset""")

_NULLS = " UNION ALL ".join(
    f"SELECT '{ds}' AS dataset, '{tbl}' AS table_name, '{n}' AS column_name, "
    f"count(*) FILTER (WHERE {n} IS NULL) AS null_count FROM {tbl}"
    for ds, tables in CATALOG.items() for tbl, cols in tables.items() for n, _ in cols)
ORACLE["required_null_counts"] = with_adapters(_ALL, "\nSELECT * FROM (" + _NULLS + ") AS n")

# Streaming == batch.
ORACLE["stream_traces"] = with_adapters(["session_traces"], "SELECT * FROM session_traces")
ORACLE["stream_hourly_errors"] = with_adapters(["error_logs"], """
, w AS (SELECT time_bucket(INTERVAL 1 HOUR, log_timestamp) AS window_start, severity, count(*) AS errors
       FROM error_logs GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, severity, errors FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(log_timestamp) FROM error_logs) - INTERVAL 2 HOUR""")
ORACLE["stream_gate_dedup"] = with_adapters(["loop_events"], """
SELECT loop_id, step_name AS gate, decision, event_id, ts FROM
  (SELECT *, row_number() OVER (PARTITION BY loop_id, step_name ORDER BY ts, event_id) AS rn
   FROM loop_events WHERE decision IS NOT NULL) x WHERE rn = 1""")
ORACLE["stream_latest_state"] = with_adapters(["session_traces"], """
SELECT loop_id, step_name AS current_step, ts AS updated_at FROM
  (SELECT loop_id, step_name, ts, row_number() OVER (PARTITION BY loop_id ORDER BY ts DESC, event_id DESC) AS rn
   FROM session_traces) x WHERE rn = 1""")
