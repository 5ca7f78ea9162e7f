"""Run scoring over recorded delivery runs.

Scores are two-decimal values computed in ``decimal`` (no binary-float
rounding), cast to double at the end.  Per-session inputs come from
aggregates over the trace log (``harvest_sessions``), never from collected
per-session arrays, so a session with millions of steps is still spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions.windows import running, slice_of
from ..sources.adapters import PROCESS_STATES
from . import quality as Q

PASS_GATE = 0.85


def _dec(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(10,4)")


def _score(x: Column) -> Column:
    """Round a decimal score HALF_UP to 2 places, as double."""
    return F.round(x.cast("decimal(10,4)"), 2).cast("double")


def _pct(score: str) -> Column:
    """A two-decimal score x100 (an integral value), as double for formatting."""
    return (F.col(score).cast("decimal(10,2)") * 100).cast("double")


def state_position(step: Column | str) -> Column:
    """1-based position in the process graph; 0 for an unknown state."""
    s = F.col(step) if isinstance(step, str) else step
    pos = F.array_position(F.array(*[F.lit(x) for x in PROCESS_STATES]), s)
    return F.coalesce(pos, F.lit(0)).cast("int")


# G1
def gherkin_score(text: Column | str, domain: Column | str, feats: dict | None = None) -> Column:
    """Score of the spec contract; ``feats`` are precomputed text features
    (:func:`quality.with_case_folds`), else computed inline."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.size(Q.tier1_violations(t, domain, **(feats or {})))
    return (F.when(t.isNull() | (t == ""), F.lit(0.0))
            .when(n == 0, F.lit(1.0))
            .otherwise(_score(_dec(1) - F.least(_dec("0.25") * n, _dec(1)))))


# G3
def skill_score(text: Column | str, domain: Column | str, upper: Column | None = None) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    n = F.size(Q.domain_rule_violations(t, domain, upper))
    return (F.when(t.isNull() | (t == ""), F.lit(0.0))
            .when(n == 0, F.lit(1.0))
            .otherwise(_score(F.greatest(_dec(1) - _dec("0.3") * n, _dec(0)))))


# G4
def sandbox_score(pass_rate: Column | str, exit_code: Column | str) -> Column:
    rate = F.col(pass_rate) if isinstance(pass_rate, str) else pass_rate
    code = F.col(exit_code) if isinstance(exit_code, str) else exit_code
    return (F.when(rate.isNull(), F.lit(0.0))
            .when((F.coalesce(code, F.lit(1)) == 0) & (rate == 100.0), F.lit(1.0))
            .otherwise(_score(rate.cast("decimal(10,4)") / 100 * _dec("0.8"))))


# G2 / G13 --------------------------------------------------------------------
def trajectory_matches(traces: DataFrame) -> DataFrame:
    """Per trace row: does the step advance the process?  A step matches iff
    its graph position exceeds the running max of all earlier positions of
    the session (equivalent to walking the expected sequence)."""
    domain = ["node_id"] if "node_id" in traces.columns else []
    t = (traces.select("loop_id", "event_id", "ts", "step_name", "status", *domain)
         .withColumn("pos", state_position("step_name"))
         .withColumn("slice", slice_of("ts")))
    t = running(t, ["loop_id"], "slice", ["ts", "event_id"], "pos", "prev_max", agg="max", inclusive=False)
    return t.withColumn("matched", F.col("pos") > F.coalesce("prev_max", F.lit(0))).drop("slice")


def gate_decisions(loop_events: DataFrame) -> DataFrame:
    """Effective (first) decision per loop and gate, as two columns."""
    first = (loop_events.filter(F.col("decision").isNotNull())
             .groupBy("loop_id", "step_name")
             .agg(F.min_by("decision", F.struct("ts", "event_id")).alias("decision")))
    return first.groupBy("loop_id").agg(
        F.max(F.when(F.col("step_name") == "GATE_H1", F.col("decision"))).alias("h1_decision"),
        F.max(F.when(F.col("step_name") == "GATE_H2", F.col("decision"))).alias("h2_decision"))


def harvest_sessions(traces: DataFrame, loop_events: DataFrame) -> DataFrame:
    """One row per session from the event log (aggregates only)."""
    m = trajectory_matches(traces)
    s = m.groupBy("loop_id").agg(
        F.min("node_id").alias("domain"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if("matched").alias("matched_steps"),
        F.max_by("step_name", F.struct("ts", "event_id")).alias("final_state"),
        F.count_if(F.col("status").isin("FAILED", "ERROR")).alias("failed_tools"),
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    g = gate_decisions(loop_events)
    s = s.join(g, "loop_id", "left")
    return s.select(
        "loop_id", "domain", "steps", "matched_steps", "final_state", "failed_tools", "started_at", "ended_at",
        F.coalesce(F.col("h1_decision") == "approve", F.lit(False)).alias("h1_approved"),
        F.coalesce(F.col("h2_decision") == "approve", F.lit(False)).alias("h2_approved"))


def trajectory_score(sessions: DataFrame) -> DataFrame:
    return sessions.select("loop_id", "steps", "matched_steps",
                           fx.half_up_ratio("matched_steps", "steps", 2).alias("trajectory_score"))


# G7-G9 ----------------------------------------------------------------------
def task_success(final_state: Column | str, h1: Column | str, h2: Column | str) -> Column:
    return F.when((F.col(final_state) == "DONE") & F.col(h1) & F.col(h2), 1.0).otherwise(0.0)


def tool_use_score(failed: Column | str) -> Column:
    f = F.col(failed) if isinstance(failed, str) else failed
    return F.when(f == 0, F.lit(1.0)).otherwise(_score(F.greatest(_dec(0), _dec(1) - _dec("0.3") * f)))


def instruction_score(final_output: Column | str) -> Column:
    return F.when(F.size(Q.guardrail_hits(final_output)) > 0, 0.0).otherwise(1.0)


# G10 / G11 -------------------------------------------------------------------
def flywheel_report(sessions: DataFrame, conversations: DataFrame) -> DataFrame:
    """``sessions`` carry ``run_key``, the key of their conversation."""
    outputs = Q.final_outputs(conversations).withColumnRenamed("conv_id", "run_key")
    s = sessions.join(outputs, "run_key", "left")
    s = s.select(
        "loop_id", "domain",
        task_success("final_state", "h1_approved", "h2_approved").alias("task_success"),
        fx.half_up_ratio("matched_steps", "steps", 2).alias("trajectory_quality"),
        tool_use_score("failed_tools").alias("tool_use_quality"),
        instruction_score("final_output").alias("instruction_following"))
    agg = (_dec("0.35") * _dec(F.col("task_success")) + _dec("0.25") * _dec(F.col("trajectory_quality"))
           + _dec("0.20") * _dec(F.col("tool_use_quality")) + _dec("0.20") * _dec(F.col("instruction_following")))
    s = s.withColumn("aggregate_score", _score(agg))
    s = s.withColumn("passed", F.col("aggregate_score") >= PASS_GATE)
    s = s.withColumn("loss_cluster", F.when(
        ~F.col("passed"),
        F.when(F.col("task_success") == 0, "GATE_APPROVAL_TIMEOUT_OR_REJECTION")
        .when(F.col("trajectory_quality") < PASS_GATE, "GRAPH_ROUTING_ANOMALY")
        .when(F.col("tool_use_quality") < PASS_GATE, "TOOL_EXECUTION_FAILURE")
        .when(F.col("instruction_following") < PASS_GATE, "NON_TECHNICAL_GUARDRAIL_VIOLATION")))
    verdict = F.format_string(
        "Flywheel Quality Index: %.1f%% [TaskSuccess: %.2f, Trajectory: %.2f, ToolUse: %.2f, "
        "InstructionFollowing: %.2f]",
        _pct("aggregate_score"), "task_success", "trajectory_quality", "tool_use_quality",
        "instruction_following")
    return s.withColumn("rubric_verdict", verdict)


def loss_clusters(report: DataFrame) -> DataFrame:
    return (report.filter(F.col("loss_cluster").isNotNull())
            .groupBy("loss_cluster").agg(F.count(F.lit(1)).alias("sessions")))


# G12
ALL_DOMAINS = "ALL"


def suite_summary(reports: dict[str, DataFrame]) -> DataFrame:
    """Mean score, all-passed and gate of each suite (a report with ``domain``,
    ``aggregate_score`` and ``passed``), per domain and over all domains: the
    reports are united and both groupings come from one pass."""
    runs = None
    for suite, report in reports.items():
        part = report.select(F.lit(suite).alias("suite"), "domain", "aggregate_score", "passed")
        runs = part if runs is None else runs.unionByName(part)
    runs = runs.withColumn("_hundredths", (F.col("aggregate_score").cast("decimal(10,2)") * 100).cast("long"))
    g = runs.groupingSets([["suite", "domain"], ["suite"]], "suite", "domain").agg(
        F.grouping("domain").alias("_all"), F.count(F.lit(1)).alias("runs"), F.sum("_hundredths").alias("_s"),
        F.bool_and("passed").alias("all_passed"))
    g = g.withColumn("mean_aggregate_score", fx.half_up_ratio("_s", "runs", 0) / F.lit(100.0))
    return g.select("suite", F.when(F.col("_all") == 1, ALL_DOMAINS).otherwise(F.col("domain")).alias("domain"), "runs",
                    "mean_aggregate_score", "all_passed", (F.col("mean_aggregate_score") >= PASS_GATE).alias("gate_passed"))


# G5 --------------------------------------------------------------------------
def scorecard(sessions: DataFrame, specs: DataFrame, results: DataFrame) -> DataFrame:
    """Quality index per run: spec contract, graph conformance, skill rules,
    sandbox reliability.  ``sessions`` carry ``run_key``, the key of their
    spec and test results; a run without a spec scores 0 on both spec scores.
    Only the specs of the runs are checked."""
    scored = specs.join(sessions.select(F.col("run_key").alias("doc_id")), "doc_id", "left_semi")
    sp = Q.with_case_folds(scored).select(
        F.col("doc_id").alias("run_key"), "text", "node_id",
        gherkin_score("text", "node_id", Q.features()).alias("gherkin_contract_score"),
        skill_score("text", "node_id", F.col("_uc")).alias("skill_compliance_score"))
    tr = results.select(F.col("run_id").alias("run_key"), "pass_rate", "exit_code")
    s = sessions.join(sp, "run_key", "left").join(tr, "run_key", "left")
    s = s.select(
        "loop_id", "domain",
        F.coalesce("gherkin_contract_score", F.lit(0.0)).alias("gherkin_contract_score"),
        fx.half_up_ratio("matched_steps", "steps", 2).alias("graph_conformance_score"),
        F.coalesce("skill_compliance_score", F.lit(0.0)).alias("skill_compliance_score"),
        sandbox_score("pass_rate", "exit_code").alias("sandbox_reliability_score"))
    agg = (_dec("0.3") * _dec(F.col("gherkin_contract_score")) + _dec("0.25") * _dec(F.col("graph_conformance_score"))
           + _dec("0.25") * _dec(F.col("skill_compliance_score"))
           + _dec("0.2") * _dec(F.col("sandbox_reliability_score")))
    s = s.withColumn("aggregate_score", _score(agg)).withColumn("passed", F.col("aggregate_score") >= PASS_GATE)
    summary = F.format_string(
        "Evaluation Quality Index: %.1f%% (Gherkin: %.2f, Graph: %.2f, Skill: %.2f, Sandbox: %.2f)",
        _pct("aggregate_score"), "gherkin_contract_score", "graph_conformance_score",
        "skill_compliance_score", "sandbox_reliability_score")
    return s.withColumn("summary", summary)


# G6 --------------------------------------------------------------------------
def protocol_scorecard(responses: DataFrame) -> DataFrame:
    p = F.when(F.col("protocol_ok"), 1.0).otherwise(0.0)
    r = F.when(F.col("correct_domain"), 1.0).otherwise(0.5)
    a = F.when(F.col("has_artifacts"), 1.0).otherwise(0.5)
    lc = F.when(F.col("lifecycle_ok"), 1.0).otherwise(0.0)
    agg = _dec("0.35") * _dec(p) + _dec("0.25") * _dec(r) + _dec("0.20") * _dec(a) + _dec("0.20") * _dec(lc)
    domain = [F.col("node_id").alias("domain")] if "node_id" in responses.columns else []
    out = responses.select("response_id", *domain, p.alias("protocol_score"), r.alias("routing_score"),
                           a.alias("artifact_score"), lc.alias("lifecycle_score"), _score(agg).alias("aggregate_score"))
    return out.withColumn("passed", F.col("aggregate_score") >= PASS_GATE)
