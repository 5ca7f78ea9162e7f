"""DuckDB oracle texts for the quality checks (F*)."""

from __future__ import annotations

from ..sources.adapters import with_adapters
from ..sources.rules import DOMAIN_RULES
from .oracle_frontmatter import block_defect


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]::varchar[]"


def rule_case(domain: str, field: str) -> str:
    arms = " ".join(f"WHEN {_q(d)} THEN {_list(r[field]) if isinstance(r[field], list) else r[field]}"
                    for d, r in DOMAIN_RULES.items())
    default = DOMAIN_RULES["finance"][field]
    default = _list(default) if isinstance(default, list) else default
    return f"(CASE {domain} {arms} ELSE {default} END)"


FM = r"'(?s)^---\s*\n(.*?)\n---\s*\n'"
BLANK = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
         r"\x{205F}\x{3000}]")
EMPTY = rf"(text IS NULL OR regexp_replace(text, '{BLANK}', '', 'g') = '')"
BREAKS = r"'[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]'"


def f1(t="text"):
    return f"(CASE WHEN regexp_matches({t}, {FM}) THEN []::varchar[] ELSE ['Missing YAML frontmatter block (enclosed in ''---'').'] END)"


def f2(t="text"):
    keys = f"regexp_extract_all(regexp_extract({t}, {FM}, 1), '(?m)^([A-Za-z_][A-Za-z0-9_]*)[ \\t]*:', 1)"
    req = "['id', 'title', 'node_id', 'created_at', 'target_repository']"
    missing = (f"list_transform(list_filter({req}, lambda f: NOT list_contains({keys}, f)),"
               f" lambda f: 'Missing required frontmatter field ''' || f || '''.')")
    defect = block_defect(f"regexp_extract({t}, {FM}, 1)")
    return (f"(CASE WHEN regexp_matches({t}, {FM}) THEN list_transform([{defect}], lambda e: CASE WHEN e[1] IS NOT NULL THEN e "
            f"ELSE {missing} END)[1] ELSE []::varchar[] END)")


def f3(t="text"):
    arms = ", ".join(f"CASE WHEN NOT contains({t}, {_q(k)}) THEN {_q(f'Missing mandatory Gherkin keyword {chr(39)}{k}{chr(39)}.')} END"
                     for k in ["Feature:", "Scenario:", "Given", "When", "Then"])
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


def f4(t="text"):
    return (f"(CASE WHEN NOT contains({t}, '## Business Metrics') AND NOT contains({t}, '### Metrics') "
            f"THEN ['Missing mandatory ''Business Metrics'' section in spec.md.'] ELSE []::varchar[] END)")


def f5(t="text", d="node_id"):
    return (f"list_transform(list_filter({rule_case(d, 'prohibited')}, lambda p: contains(upper({t}), p)),"
            f" lambda p: 'Domain policy violation: spec contains prohibited SQL operation ''' || p || '''')")


def f6(t="text", d="node_id"):
    return (f"list_transform(list_filter({rule_case(d, 'metrics')}, lambda m: NOT contains({t}, m)),"
            f" lambda m: 'Domain policy violation: missing mandatory metric ''' || m || '''')")


def f7(t="text", d="node_id"):
    return (f"(CASE WHEN {EMPTY} THEN ['Specification content is empty.'] ELSE "
            f"list_concat({f1(t)}, {f2(t)}, {f3(t)}, {f4(t)}, {f5(t, d)}, {f6(t, d)}) END)")


def lines(t="text"):
    t2 = f"replace({t}, chr(13) || chr(10), chr(10))"
    return (f"(CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE length({t2}) - length(regexp_replace({t2}, {BREAKS}, '', 'g'))"
            f" + 1 - (CASE WHEN regexp_matches({t2}, {BREAKS[:-1]}\\z') THEN 1 ELSE 0 END) END)")


def f8(t="text"):
    low = f"lower(coalesce({t}, ''))"
    priv = " OR ".join(f"contains({low}, '{w}')" for w in ["credit_card", "ssn", "password"])
    return (f"list_filter([CASE WHEN {priv} THEN 'GDPR/SOC 2 violation: spec mentions unmasked sensitive personal identifiers.' END, "
            f"CASE WHEN {lines(f'coalesce({t}, {chr(39)}{chr(39)})')} < 10 THEN "
            f"'Scope violation: specification is too brief and lacks detailed acceptance scenarios.' END], lambda x: x IS NOT NULL)")


def report(arr: str) -> str:
    return with_adapters(["specs"], f"""
SELECT doc_id, node_id, len(v) AS violation_count, array_to_string(v, ' | ') AS violations
FROM (SELECT doc_id, node_id, {arr} AS v FROM specs) s""")


ORACLE: dict[str, str] = {
    "spec_frontmatter": report(f1()),
    "spec_required_fields": report(f2()),
    "spec_gherkin": report(f3()),
    "spec_metrics_section": report(f4()),
    "spec_prohibited_sql": report(f5()),
    "spec_missing_metrics": report(f6()),
    "tier1_violations": report(f7()),
    "tier2_policy": report(f8()),
}

ORACLE["spec_harness"] = with_adapters(["specs"], f"""
, s AS (SELECT doc_id, node_id, {f7()} AS t1, {f8()} AS t2 FROM specs),
v AS (SELECT doc_id, node_id, t1, t2, CASE WHEN len(t1) > 0 THEN t1 ELSE t2 END AS v FROM s)
SELECT doc_id, node_id, len(v) = 0 AS passed,
       CASE WHEN len(t1) > 0 THEN 'TIER1' WHEN len(t2) > 0 THEN 'TIER2' ELSE 'NONE' END AS failed_tier,
       len(v) AS violation_count, array_to_string(v, ' | ') AS violations
FROM v""")


def f10(rate="coalesce(pass_rate, 0.0)", executed="executed_test_types", d="node_id"):
    minimum = rule_case(d, "min_pass_rate")
    low = (f"(CASE WHEN cast({rate} AS double) < {minimum} THEN ['Acceptance failure: unit test pass rate ' || "
           f"cast(cast({rate} AS double) AS varchar) || '% below required ' || cast(cast({minimum} AS double) AS varchar) || '%']"
           f" ELSE []::varchar[] END)")
    missing = (f"list_transform(list_filter({rule_case(d, 'test_types')}, lambda x: NOT list_contains(coalesce({executed}, []::varchar[]), x)),"
               f" lambda x: 'Acceptance failure: mandatory test type ''' || x || ''' was not executed')")
    return f"list_concat({low}, {missing})"


ORACLE["acceptance_criteria"] = with_adapters(["test_results"], f"""
SELECT run_id, node_id, len(v) AS violation_count, array_to_string(v, ' | ') AS violations
FROM (SELECT run_id, node_id, {f10()} AS v FROM test_results) s""")

ORACLE["review_outcome"] = with_adapters(["test_results"], f"""
SELECT run_id, node_id,
       CASE WHEN NOT coalesce(passed, false) OR coalesce(pass_rate, 0.0) < 100.0 THEN 'fail_fix'
            WHEN len({f10()}) > 0 THEN 'fail_fix' ELSE 'pass' END AS review_outcome
FROM test_results""")

_FORBIDDEN = "['os.system', 'subprocess.Popen', 'eval(', 'exec(', '__import__']"
ORACLE["forbidden_code_scan"] = with_adapters(["artifacts"], f"""
SELECT doc_id, artifact_name, len(h) AS hit_count, array_to_string(h, ' | ') AS hits
FROM (SELECT doc_id, artifact_name, list_filter({_FORBIDDEN}, lambda p: contains(content, p)) AS h FROM artifacts) s""")

_GUARD = "['python3 deploy_view.py', '<YOUR_PROJECT_ID>', 'pip install', 'gcloud ']"
_FINAL = """
fo AS (SELECT conv_id, arg_max(text, turn) AS final_output FROM conversation_turns WHERE role = 'assistant' GROUP BY conv_id)"""
ORACLE["guardrail_tokens"] = with_adapters(["conversation_turns"], f""",{_FINAL}
SELECT conv_id, len(h) AS hit_count, array_to_string(h, ' | ') AS hits
FROM (SELECT conv_id, list_filter({_GUARD}, lambda p: contains(coalesce(final_output, ''), p)) AS h FROM fo) s""")

ORACLE["metric_defaults"] = with_adapters(["specs"], """
SELECT metric, count(*) AS specs,
       CASE WHEN contains(metric, 'tolerance') OR contains(metric, 'pct') OR contains(metric, 'variance') THEN 0.05
            WHEN contains(metric, 'seconds') OR contains(metric, 'delay') THEN 5.0
            WHEN contains(metric, 'adherence') OR contains(metric, 'ratio') THEN 0.95
            ELSE 0.001 END::double AS default_threshold
FROM (SELECT unnest(regexp_extract_all(text, '(?m)^- ([A-Za-z_][A-Za-z0-9_]*):', 1)) AS metric FROM specs) s
GROUP BY metric""")

ORACLE["violation_summary"] = with_adapters(["specs"], f"""
, s AS (SELECT node_id, {f7()} AS t1, {f8()} AS t2 FROM specs)
SELECT node_id, violation, count(*) AS specs
FROM (SELECT node_id, unnest(CASE WHEN len(t1) > 0 THEN t1 ELSE t2 END) AS violation FROM s) u
GROUP BY node_id, violation""")


_RULES = ", ".join(f"({_q(d)}, {_q(kind)}, {i + 1}, {_q(v)})" for d, r in DOMAIN_RULES.items()
                   for kind, field in (("metrics", "metrics"), ("prohibited_patterns", "prohibited")) for i, v in enumerate(r[field]))
ORACLE["rule_usage"] = with_adapters(["specs"], f"""
SELECT r.domain, r.kind, r.pos, r.value, count(*) FILTER (CASE r.kind WHEN 'metrics' THEN NOT contains(coalesce(s.text, ''), r.value)
         ELSE contains(upper(coalesce(s.text, '')), r.value) END AND s.node_id IS NOT NULL) AS broken
FROM (VALUES {_RULES}) AS r(domain, kind, pos, value) LEFT JOIN specs s ON s.node_id = r.domain GROUP BY 1, 2, 3, 4""")
