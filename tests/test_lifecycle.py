"""Lifecycle analysis (I*): retry budget, gates, transitions."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerline.operators import lifecycle as L


def _events(spark, steps):
    t0 = datetime(2024, 1, 1)
    rows = [("L1", i, t0 + timedelta(minutes=i), s, d, o, h) for i, (s, d, o, h) in enumerate(steps)]
    return spark.createDataFrame(rows, "loop_id string, event_id long, ts timestamp_ntz, step_name string, "
                                       "decision string, review_outcome string, harness_passed boolean").withColumn("reviewer", F.lit("r@x.y"))


def test_three_retries_then_escalated(spark):
    fail = ("SPEC_HARNESS", None, None, False)
    ev = _events(spark, [fail, fail, fail, fail])
    got = [(r.charges_before, r.charged, r.escalated) for r in L.retry_budget(ev).orderBy("event_id").collect()]
    assert got == [(0, True, False), (1, True, False), (2, True, False), (3, False, True)]
    nxt = [r.next_state for r in L.next_state(ev).orderBy("event_id").collect()]
    assert nxt == ["SPECIFY", "SPECIFY", "SPECIFY", "ESCALATED"]


def test_gate_routes_and_uncapped_changes(spark):
    ev = _events(spark, [
        ("GATE_H1", None, None, None), ("GATE_H1", "request_changes", None, None),
        ("GATE_H1", "approve", None, None), ("REVIEW", None, "fail_design", None),
        ("GATE_H2", "request_changes", None, None), ("GATE_H2", "reject", None, None),
    ])
    nxt = [r.next_state for r in L.next_state(ev).orderBy("event_id").collect()]
    assert nxt == ["WAIT_GATE_H1", "SPECIFY", "DESIGN", "DESIGN", "REVIEW", "CLOSED"]
    first = {r.event_id: r.status for r in L.first_gate_resolution(ev).collect()}
    assert first == {1: "EFFECTIVE", 2: "CONFLICT", 4: "EFFECTIVE", 5: "CONFLICT"}


def test_latest_state_and_step_limit(spark):
    ev = _events(spark, [("INTAKE", None, None, None)] + [("DESIGN", None, None, None)] * 26)
    tr = L.transitions(ev)
    latest = L.latest_loop_state(tr).first()
    assert latest.current_state == "IMPLEMENT"
    seg = L.step_limit(tr).collect()
    assert [(r.segment, r.steps, r.escalated) for r in seg] == [(0, 27, True)]


def test_budget_equals_the_rule_applied_event_by_event(spark):
    """Random mixes of capped and uncapped charges over many slices."""
    rng = random.Random(5)
    steps = [("SPEC_HARNESS", None, None, False), ("SPEC_HARNESS", None, None, True), ("GATE_H1", "request_changes", None, None),
             ("REVIEW", None, "fail_spec", None), ("REVIEW", None, "fail_fix", None), ("GATE_H2", "request_changes", None, None),
             ("REVIEW", None, "pass", None), ("DESIGN", None, None, None)]
    t0, rows, expected = datetime(2024, 1, 1), [], {}
    for loop in range(30):
        counts, at = {}, t0
        for i in range(rng.choice([1, 4, 40])):
            step, decision, outcome, passed = rng.choice(steps)
            at += timedelta(minutes=rng.choice([0, 1, 7, 30]))
            event = loop * 100 + i
            rows.append((f"L{loop}", event, at, step, decision, outcome, passed))
            capped = step in ("SPEC_HARNESS", "REVIEW")
            dest = ("SPECIFY" if step == "SPEC_HARNESS" and not passed or step == "GATE_H1" or outcome == "fail_spec"
                    else "IMPLEMENT" if outcome == "fail_fix" or step == "GATE_H2" else None)
            if dest:
                before = counts.get(dest, 0)
                escalated = capped and before >= 3
                expected[event] = (dest, before, escalated)
                counts[dest] = before + (not escalated)
    ev = spark.createDataFrame(rows, "loop_id string, event_id long, ts timestamp_ntz, step_name string, decision string, "
                                     "review_outcome string, harness_passed boolean")
    got = {r.event_id: (r.destination, r.charges_before, r.escalated) for r in L.retry_budget(ev).collect()}
    assert got == expected and any(e[2] for e in expected.values())


def test_reasons_name_violations_outcome_and_reviewer(spark):
    fail = ("SPEC_HARNESS", None, None, False)
    ev = _events(spark, [fail, fail, fail, fail, fail, ("GATE_H1", "reject", None, None)] + [("REVIEW", None, "fail_fix", None)] * 4)
    reports = spark.createDataFrame(
        [("L1", 1, datetime(2024, 1, 1, 0, 0), ["old"]), ("L1", 2, datetime(2024, 1, 1, 0, 3), ["a", "b"]),
         ("L1", 3, datetime(2024, 1, 1, 0, 4, 30), ["later"]), ("L2", 4, datetime(2024, 1, 1), ["other"])],
        "loop_id string, event_id long, ts timestamp_ntz, violations array<string>")
    reasons = {r.event_id: r.reason for r in L.next_state(ev, reports).collect()}
    harness = "Spec harness validation failed after 3 retries. Violations: "
    assert reasons[2] is None and reasons[3] == reasons[4] == harness + "a, b"
    assert reasons[5] == "Gate H1 rejected by human reviewer (r@x.y)."
    assert reasons[9] == "Reviewer returned 'fail_fix' and retry limit (3) for node 'IMPLEMENT' was reached."
    budget = {r.event_id: r.reason for r in L.retry_budget(ev, reports).collect()}
    assert {k: v for k, v in reasons.items() if v and k != 5} == {k: v for k, v in budget.items() if v}
    assert {r.event_id: r.reason for r in L.next_state(ev).collect()}[3] == harness + "Unknown violations"
