"""Bulk specification / document quality checks.

Each rule is an ``array<string>`` column of violation messages built from
substring and regex expressions, so the whole table is checked in one
narrow (shuffle-free) stage; only the summaries group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import block_defect
from ..sources.rules import DEFAULT_DOMAIN, DOMAIN_RULES, known_domain, rule_tables

# ---------------------------------------------------------------------------
# Rule keywords and violation messages of the checks.
# ---------------------------------------------------------------------------
REQUIRED_FRONTMATTER_FIELDS = ["id", "title", "node_id", "created_at", "target_repository"]
GHERKIN_KEYWORDS = ["Feature:", "Scenario:", "Given", "When", "Then"]
METRICS_HEADINGS = ["## Business Metrics", "### Metrics"]
PRIVACY_TERMS = ["credit_card", "ssn", "password"]
MIN_SPEC_LINES = 10
FORBIDDEN_CODE_PATTERNS = ["os.system", "subprocess.Popen", "eval(", "exec(", "__import__"]
GUARDRAIL_TOKENS = ["python3 deploy_view.py", "<YOUR_PROJECT_ID>", "pip install", "gcloud "]

MSG_EMPTY = "Specification content is empty."
MSG_NO_FRONTMATTER = "Missing YAML frontmatter block (enclosed in '---')."
MSG_FIELD = "Missing required frontmatter field '{}'."
MSG_GHERKIN = "Missing mandatory Gherkin keyword '{}'."
MSG_METRICS_SECTION = "Missing mandatory 'Business Metrics' section in spec.md."
MSG_PROHIBITED = "Domain policy violation: spec contains prohibited SQL operation '{}'"
MSG_MISSING_METRIC = "Domain policy violation: missing mandatory metric '{}'"
MSG_PRIVACY = "GDPR/SOC 2 violation: spec mentions unmasked sensitive personal identifiers."
MSG_SCOPE = "Scope violation: specification is too brief and lacks detailed acceptance scenarios."
MSG_PASS_RATE = "Acceptance failure: unit test pass rate {}% below required {}%"
MSG_TEST_TYPE = "Acceptance failure: mandatory test type '{}' was not executed"

FRONTMATTER_RE = r"(?s)^---\s*\n(.*?)\n---\s*\n"
TOP_LEVEL_KEY_RE = r"(?m)^([A-Za-z_][A-Za-z0-9_]*)[ \t]*:"
# Line boundaries of Python's str.splitlines (\r\n counts once).
LINE_BREAK_CLASS = r"[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _msg(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _present(*items: tuple[Column, str]) -> Column:
    """Array of the messages whose condition holds, in order.  Unrolled into
    ``concat(when(...))`` (code-generated; no interpreted lambda)."""
    if not items:
        return _empty()
    return F.concat(*[F.when(cond, F.array(F.lit(m))).otherwise(_empty()) for cond, m in items])


def by_domain(domain: Column | str, build) -> Column:
    """``build(rules)`` for the row's domain (unknown -> finance), as a CASE
    over the fixed domains, so per-domain keyword lists unroll too."""
    d = known_domain(_c(domain))
    chain = None
    for name, rules in DOMAIN_RULES.items():
        if name == DEFAULT_DOMAIN:
            continue
        chain = F.when(d == name, build(rules)) if chain is None else chain.when(d == name, build(rules))
    return chain.otherwise(build(DOMAIN_RULES[DEFAULT_DOMAIN]))


def with_case_folds(df: DataFrame, text: str = "text") -> DataFrame:
    """Per-row text features computed once (a projection Catalyst keeps,
    since each feature is used by several rules): upper/lower-cased text,
    frontmatter presence and keys, blankness, line count."""
    t = F.col(text)
    has_fm = t.rlike(FRONTMATTER_RE)
    return (df.withColumn("_uc", F.upper(t)).withColumn("_lc", F.lower(t))
            .withColumn("_fm", has_fm)
            .withColumn("_keys", frontmatter_keys(t))
            .withColumn("_defect", F.when(has_fm, block_defect(F.regexp_extract(t, FRONTMATTER_RE, 1))))
            .withColumn("_blank", is_blank(t))
            .withColumn("_lines", line_count(t)))


def features() -> dict[str, Column]:
    """Column references to the features added by :func:`with_case_folds`."""
    return {"upper": F.col("_uc"), "has_fm": F.col("_fm"), "keys": F.col("_keys"), "blank": F.col("_blank"),
            "defect": F.col("_defect")}


def frontmatter_keys(text: Column | str) -> Column:
    block = F.regexp_extract(_c(text), FRONTMATTER_RE, 1)
    return F.regexp_extract_all(block, F.lit(TOP_LEVEL_KEY_RE), F.lit(1))


# The characters that Python's str.strip() removes.
BLANK_CLASS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
               r"\x{205F}\x{3000}]")


def is_blank(text: Column | str) -> Column:
    t = _c(text)
    return t.isNull() | t.rlike(rf"\A{BLANK_CLASS}*\z")


def line_count(text: Column | str) -> Column:
    """Number of lines as Python ``len(text.splitlines())``: line breaks
    (``\\r\\n`` counted once) + 1, minus a trailing break; one regex pass."""
    t = _c(text)
    breaks = F.regexp_count(t, F.lit("\r\n|" + LINE_BREAK_CLASS))
    trailing = F.when(F.substring(t, -1, 1).rlike(LINE_BREAK_CLASS), 1).otherwise(0)
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(breaks + 1 - trailing)


# F1
def frontmatter_violations(text: Column | str, has_fm: Column | None = None) -> Column:
    has_fm = _c(text).rlike(FRONTMATTER_RE) if has_fm is None else has_fm
    return F.when(has_fm, _empty()).otherwise(F.array(F.lit(MSG_NO_FRONTMATTER)))


# F2
def required_field_violations(text: Column | str, has_fm: Column | None = None,
                              keys: Column | None = None, defect: Column | None = None) -> Column:
    """Frontmatter that is no mapping or cannot be read is one violation; else
    each required field that is missing is one."""
    t = _c(text)
    has_fm = t.rlike(FRONTMATTER_RE) if has_fm is None else has_fm
    keys = frontmatter_keys(t) if keys is None else keys
    defect = block_defect(F.regexp_extract(t, FRONTMATTER_RE, 1)) if defect is None else defect
    missing = _present(*[(~F.array_contains(keys, f), MSG_FIELD.format(f)) for f in REQUIRED_FRONTMATTER_FIELDS])
    return F.when(has_fm, F.when(defect.isNotNull(), F.array(defect)).otherwise(missing)).otherwise(_empty())


# F3
def gherkin_violations(text: Column | str) -> Column:
    t = _c(text)
    return _present(*[(~t.contains(kw), MSG_GHERKIN.format(kw)) for kw in GHERKIN_KEYWORDS])


# F4
def metrics_section_violations(text: Column | str) -> Column:
    t = _c(text)
    missing = ~t.contains(METRICS_HEADINGS[0]) & ~t.contains(METRICS_HEADINGS[1])
    return _present((missing, MSG_METRICS_SECTION))


# F5
def prohibited_sql_violations(text: Column | str, domain: Column | str, upper: Column | None = None) -> Column:
    upper = F.upper(_c(text)) if upper is None else upper
    return by_domain(domain, lambda r: _present(*[(upper.contains(p), MSG_PROHIBITED.format(p))
                                                  for p in r["prohibited"]]))


# F6
def missing_metric_violations(text: Column | str, domain: Column | str) -> Column:
    t = _c(text)
    return by_domain(domain, lambda r: _present(*[(~t.contains(m), MSG_MISSING_METRIC.format(m))
                                                  for m in r["metrics"]]))


# F7
def tier1_violations(text: Column | str, domain: Column | str, upper: Column | None = None,
                     has_fm: Column | None = None, keys: Column | None = None,
                     blank: Column | None = None, defect: Column | None = None) -> Column:
    t = _c(text)
    parts = F.concat(
        frontmatter_violations(t, has_fm), required_field_violations(t, has_fm, keys, defect), gherkin_violations(t),
        metrics_section_violations(t), prohibited_sql_violations(t, domain, upper),
        missing_metric_violations(t, domain))
    return F.when(is_blank(t) if blank is None else blank, F.array(F.lit(MSG_EMPTY))).otherwise(parts)


def domain_rule_violations(text: Column | str, domain: Column | str, upper: Column | None = None) -> Column:
    """F5 + F6 (the skill-registry part of tier 1)."""
    return F.concat(prohibited_sql_violations(text, domain, upper), missing_metric_violations(text, domain))


# A6
def rule_usage(specs: DataFrame) -> DataFrame:
    """The manifests' metrics and prohibited patterns, one row per rule, with
    the number of specifications that break it.  A specification names the
    rules it breaks in one projection; only (domain, rule) counts are grouped
    and joined to the rule tables."""
    text, upper = F.coalesce(F.col("text"), F.lit("")), F.col("_upper")

    def rule(kind: str, value: str) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value")))

    none = F.array().cast("array<struct<kind:string,value:string>>")
    broken = by_domain("node_id", lambda r: F.concat(
        *[F.when(~text.contains(m), rule("metrics", m)).otherwise(none) for m in r["metrics"]],
        *[F.when(upper.contains(p), rule("prohibited_patterns", p)).otherwise(none) for p in r["prohibited"]]))
    found = (specs.withColumn("_upper", F.upper(text)).select(known_domain(F.col("node_id")).alias("domain"), F.explode(broken).alias("r"))
             .groupBy("domain", "r.kind", "r.value").agg(F.count(F.lit(1)).alias("broken")))
    tables = rule_tables(specs.sparkSession)
    rules = [tables[kind].select("domain", F.lit(kind).alias("kind"), "pos", "value") for kind in ("metrics", "prohibited_patterns")]
    return rules[0].unionByName(rules[1]).join(found, ["domain", "kind", "value"], "left").select(
        "domain", "kind", "pos", "value", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


# F8
def tier2_violations(text: Column | str, lower: Column | None = None, lines: Column | None = None) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    low = F.lower(t) if lower is None else F.coalesce(lower, F.lit(""))
    n = line_count(t) if lines is None else lines
    privacy = low.contains(PRIVACY_TERMS[0]) | low.contains(PRIVACY_TERMS[1]) | low.contains(PRIVACY_TERMS[2])
    return _present((privacy, MSG_PRIVACY), (n < MIN_SPEC_LINES, MSG_SCOPE))


# F9
def spec_harness(specs: DataFrame) -> DataFrame:
    """Tier 1 decides; tier 2 only when tier 1 is clean.  Note: a filter on
    the result's ``passed``/``violation_count`` is pushed by Catalyst below
    this projection with the rule expressions inlined (correct, but one very
    large generated method); aggregate, join or write the result first."""
    s = with_case_folds(specs).select("doc_id", "node_id",
                                      tier1_violations("text", "node_id", **features()).alias("t1"),
                                      tier2_violations("text", F.col("_lc"), F.col("_lines")).alias("t2"))
    failed_t1 = F.size("t1") > 0
    v = F.when(failed_t1, F.col("t1")).otherwise(F.col("t2"))
    return s.select(
        "doc_id", "node_id",
        (F.size(v) == 0).alias("passed"),
        F.when(failed_t1, "TIER1").when(F.size("t2") > 0, "TIER2").otherwise("NONE").alias("failed_tier"),
        F.size(v).alias("violation_count"),
        F.array_join(v, " | ").alias("violations"))


def _report(df: DataFrame, keys: list[str], arr: Column, count_name: str = "violation_count",
            text_name: str = "violations") -> DataFrame:
    """Project the array once, then its size and joined text."""
    return df.select(*keys, arr.alias("_v")).select(
        *keys, F.size("_v").alias(count_name), F.array_join("_v", " | ").alias(text_name))


def rule_report(specs: DataFrame, violations: Column) -> DataFrame:
    """(doc_id, node_id, violation_count, violations) for one rule column."""
    return _report(specs, ["doc_id", "node_id"], violations)


# F10
def acceptance_violations(pass_rate: Column | str, executed: Column | str, domain: Column | str) -> Column:
    rate = F.coalesce(_c(pass_rate).cast("double"), F.lit(0.0))  # a run without a rate passed nothing
    ran = F.coalesce(_c(executed), _empty())

    def build(r):
        minimum = float(r["min_pass_rate"])
        low = F.when(rate < F.lit(minimum), F.array(F.concat(
            F.lit("Acceptance failure: unit test pass rate "), rate.cast("string"),
            F.lit(f"% below required {minimum}%")))).otherwise(_empty())
        return F.concat(low, _present(*[(~F.array_contains(ran, x), MSG_TEST_TYPE.format(x))
                                        for x in r["test_types"]]))
    return by_domain(domain, build)


def acceptance_report(results: DataFrame) -> DataFrame:
    v = acceptance_violations("pass_rate", "executed_test_types", "node_id")
    return _report(results, ["run_id", "node_id"], v)


# F11
def review_outcome(results: DataFrame) -> DataFrame:
    v = acceptance_violations("pass_rate", "executed_test_types", "node_id")
    failed_tests = ~F.coalesce(F.col("passed"), F.lit(False)) | (F.coalesce(F.col("pass_rate"), F.lit(0.0)) < 100.0)
    outcome = F.when(failed_tests, "fail_fix").when(F.size(v) > 0, "fail_fix").otherwise("pass")
    return results.select("run_id", "node_id", outcome.alias("review_outcome"))


# F12
def forbidden_code_hits(content: Column | str) -> Column:
    c = _c(content)
    return _present(*[(c.contains(p), p) for p in FORBIDDEN_CODE_PATTERNS])


def forbidden_code_scan(artifacts: DataFrame) -> DataFrame:
    return _report(artifacts, ["doc_id", "artifact_name"], forbidden_code_hits("content"), "hit_count", "hits")


# F13
def guardrail_hits(output: Column | str) -> Column:
    o = F.coalesce(_c(output), F.lit(""))
    return _present(*[(o.contains(p), p) for p in GUARDRAIL_TOKENS])


def final_outputs(conversations: DataFrame) -> DataFrame:
    """Final output of each conversation: its last assistant turn (max_by is
    a one-value buffer per group, combined map-side)."""
    return (conversations.filter(F.col("role") == "assistant")
            .groupBy("conv_id").agg(F.max_by("text", "turn").alias("final_output")))


def guardrail_scan(conversations: DataFrame) -> DataFrame:
    return _report(final_outputs(conversations), ["conv_id"], guardrail_hits("final_output"), "hit_count", "hits")


# F14
def metric_default(name: Column | str) -> Column:
    n = _c(name)
    return (F.when(n.contains("tolerance") | n.contains("pct") | n.contains("variance"), 0.05)
            .when(n.contains("seconds") | n.contains("delay"), 5.0)
            .when(n.contains("adherence") | n.contains("ratio"), 0.95)
            .otherwise(0.001))


def metric_defaults(specs: DataFrame) -> DataFrame:
    names = F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^- ([A-Za-z_][A-Za-z0-9_]*):"), F.lit(1))
    m = specs.select(F.explode(names).alias("metric"))
    return m.groupBy("metric").agg(F.count(F.lit(1)).alias("specs")).withColumn(
        "default_threshold", metric_default("metric"))


# F15
def violation_summary(specs: DataFrame) -> DataFrame:
    s = with_case_folds(specs).select("node_id", tier1_violations("text", "node_id", **features()).alias("t1"),
                                      tier2_violations("text", F.col("_lc"), F.col("_lines")).alias("t2"))
    v = F.when(F.size("t1") > 0, F.col("t1")).otherwise(F.col("t2"))
    e = s.select("node_id", F.explode(v).alias("violation"))
    return e.groupBy("node_id", "violation").agg(F.count(F.lit(1)).alias("specs"))
