"""Spec checks (F*): reference behaviour on hand-written specs."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q

VALID_FINANCE = """---
id: "SPEC-FINANCE-0001"
title: "Weekly currency variance"
node_id: "finance"
created_at: "2026-01-01T00:00:00Z"
target_repository: "analytics-views"
---
# Weekly currency variance

Feature: currency variance view
  Scenario: invoices are converted to USD
    Given the invoices and the exchange rates
    When the weekly view is computed
    Then every paid invoice has a USD amount

## Business Metrics
- target_sla_seconds: 5.0
- baseline_error_rate: 0.001
- reconciliation_variance_tolerance_pct: 0.05
"""


def _violations(spark, text, domain="finance"):
    df = spark.createDataFrame([(text, domain)], "text string, node_id string")
    r = df.select(Q.tier1_violations("text", "node_id").alias("t1"), Q.tier2_violations("text").alias("t2")).first()
    return r.t1, r.t2


def test_valid_spec_has_no_violations(spark):
    t1, t2 = _violations(spark, VALID_FINANCE)
    assert t1 == [] and t2 == []


def test_missing_metric_and_drop_table(spark):
    text = VALID_FINANCE.replace("- reconciliation_variance_tolerance_pct: 0.05\n", "") + "drop table invoices;\n"
    t1, _ = _violations(spark, text)
    assert t1 == [
        "Domain policy violation: spec contains prohibited SQL operation 'DROP TABLE'",
        "Domain policy violation: missing mandatory metric 'reconciliation_variance_tolerance_pct'",
    ]


def test_empty_and_missing_parts(spark):
    assert _violations(spark, "   \n\t")[0] == ["Specification content is empty."]
    t1, t2 = _violations(spark, "just text", "unknown-domain")
    assert t1[0] == "Missing YAML frontmatter block (enclosed in '---')."
    assert "Missing mandatory Gherkin keyword 'Feature:'." in t1
    assert "Missing mandatory 'Business Metrics' section in spec.md." in t1
    # unknown domain -> finance rules
    assert "Domain policy violation: missing mandatory metric 'reconciliation_variance_tolerance_pct'" in t1
    assert t2 == ["Scope violation: specification is too brief and lacks detailed acceptance scenarios."]


def test_missing_frontmatter_field_and_privacy(spark):
    text = VALID_FINANCE.replace('created_at: "2026-01-01T00:00:00Z"\n', "") + "The password column is hidden.\n"
    t1, t2 = _violations(spark, text)
    assert t1 == ["Missing required frontmatter field 'created_at'."]
    assert t2 == ["GDPR/SOC 2 violation: spec mentions unmasked sensitive personal identifiers."]


_LINE_CHARS = ["a", "b", " ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "é"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(_LINE_CHARS), max_size=30))
def test_line_count_equals_python_splitlines(spark, parts):
    text = "".join(parts)
    got = spark.createDataFrame([(text,)], "t string").select(Q.line_count("t").alias("n")).first().n
    assert got == len(text.splitlines())


def test_blank_equals_python_strip(spark):
    cases = ["", " ", "\t\n", " x ", "\x0b\x0c\r", "a"]
    got = [r.b for r in spark.createDataFrame([(c,) for c in cases], "t string")
           .select(Q.is_blank("t").alias("b")).collect()]
    assert got == [not c.strip() for c in cases]


def test_acceptance_and_review(spark):
    rows = [(1, "finance", 50.0, False, ["unit"]),
            (2, "sales", 100.0, True, ["unit", "sql_syntax_lint", "pii_masking_check"]),
            (3, "sales", 100.0, True, ["unit"])]
    df = spark.createDataFrame(rows, "run_id long, node_id string, pass_rate double, passed boolean, "
                                     "executed_test_types array<string>")
    rep = {r.run_id: r.violations for r in Q.acceptance_report(df).collect()}
    assert rep[1].startswith("Acceptance failure: unit test pass rate 50.0% below required 100.0%")
    assert rep[2] == ""
    assert rep[3] == ("Acceptance failure: mandatory test type 'sql_syntax_lint' was not executed | "
                      "Acceptance failure: mandatory test type 'pii_masking_check' was not executed")
    out = {r.run_id: r.review_outcome for r in Q.review_outcome(df).collect()}
    assert out == {1: "fail_fix", 2: "pass", 3: "fail_fix"}


def test_metric_defaults_first_rule_wins(spark):
    names = ["dispatch_sla_adherence_pct", "target_sla_seconds", "telemetry_ingestion_delay_ms",
             "baseline_error_rate", "fill_ratio"]
    got = [r.d for r in spark.createDataFrame([(n,) for n in names], "m string")
           .select(Q.metric_default("m").alias("d")).collect()]
    assert got == [0.05, 5.0, 5.0, 0.001, 0.95]


def test_forbidden_and_guardrails(spark):
    df = spark.createDataFrame([("x = eval(y); os.system('ls')", "please pip install foo")], "c string, o string")
    r = df.select(Q.forbidden_code_hits("c").alias("f"), Q.guardrail_hits("o").alias("g")).first()
    assert r.f == ["os.system", "eval("] and r.g == ["pip install"]


BAD = "Failed to parse YAML frontmatter: "
CASES = [
    ("id: 1\ntitle: x", None), ("a: b\n\n# note\nc: 'it''s'\nd: \"q\\\" # x\"  # end", None), ("a: http://x:80/y\nt: 10:30:00", None),
    ("a:\n  b: c\n\n  d: e\nf: |\n  free: text: here\n  \"open", None), ("a: [1, 2]\nb: {x: 1,\n  y: [2]}\nc: d", None),
    ("a:\n- x\n- y\nb: c", None), ("a: \"two\n  lines\"\nb: c", None), ("a: plain\n  goes on\nb: c", None), ("'quoted key': v\nb:", None),
    ("a: it's fine\nb: say \"x\"", None), ("a: x # note: fine", None), ("a: b\r\nc: d", None),
    ("- a\n- b", "YAML frontmatter is not a valid dictionary."), ("just text\nmore", "YAML frontmatter is not a valid dictionary."),
    ("", "YAML frontmatter is not a valid dictionary."), ("# only a note", "YAML frontmatter is not a valid dictionary."),
    ("a: b\n\tc: d", BAD + "line 2: a tab in the indentation"), ("a: \"open\nb: c", BAD + "a quote is not closed"),
    ("a: 'open", BAD + "a quote is not closed"), ("a: 'x' y", BAD + "line 1: text after a closing quote"),
    ("a: [1\nb: c", BAD + "a bracket is not closed"), ("a: [1]]", BAD + "line 1: a bracket is closed twice"),
    ("a: [1,\n 2]}", BAD + "line 2: a bracket is closed twice"), ("a: @x", BAD + "line 1: a value cannot begin with @"),
    ("a: b: c", BAD + "line 1: a second colon in a value"), ("a: b\nwords", BAD + "line 2: text without a key"),
    ("a: b\n- c", BAD + "line 2: a list item among keys"), ("- c\na: b", BAD + "line 2: a key among list items"),
    ("text\na: b", BAD + "line 2: a key after text"), ("  a: b", BAD + "line 1: an indented line that belongs to nothing"),
    ("a: b\n  c: d", BAD + "line 2: a key under a value"), ("a: 1\nb: 2\na: 3", BAD + "line 3: key 'a' is repeated"),
]


def test_malformed_frontmatter(spark):
    import duckdb

    from ledgerline.functions.frontmatter import block_defect
    from ledgerline.plans.oracle_quality import f2

    df = spark.createDataFrame([(i, block) for i, (block, _) in enumerate(CASES)], "i int, block string")
    got = {r.i: r.d for r in df.select("i", block_defect(F.col("block")).alias("d")).collect()}
    assert [got[i] for i in range(len(CASES))] == [d for _, d in CASES]
    texts = df.select("i", F.concat(F.lit("---\n"), "block", F.lit("\n---\nFeature: x")).alias("text"))
    found = {r.i: list(r.v) for r in texts.select("i", Q.required_field_violations("text").alias("v")).collect()}
    for i, (block, defect) in enumerate(CASES):
        if defect is None:
            assert all(v.startswith("Missing required") for v in found[i]), block
        else:
            assert found[i] == [defect], block
    rows = [tuple(r) for r in texts.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i int, text varchar)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert dict(con.execute(f"SELECT i, {f2()} FROM t").fetchall()) == found


def test_rules_with_their_breaches(spark):
    df = spark.createDataFrame([("finance", "drop table x; target_sla_seconds"), ("unknown", "baseline_error_rate"), ("sales", None)],
                               "node_id string, text string")
    got = {(r.domain, r.value): r.broken for r in Q.rule_usage(df).collect()}
    assert got["finance", "DROP TABLE"] == 1 and got["finance", "target_sla_seconds"] == 1 and got["finance", "baseline_error_rate"] == 1
    assert got["finance", "reconciliation_variance_tolerance_pct"] == 2 and got["sales", "conversion_variance_pct"] == 1
    assert got["logistics", "TRUNCATE"] == 0 and len(got) == 31
