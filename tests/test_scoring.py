"""Run scoring (G*): golden edge cases and the trajectory identity."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerline.operators import scoring as G
from ledgerline.sources.adapters import PROCESS_STATES


def python_trajectory(steps):
    """The reference walk over the expected sequence."""
    if not steps:
        return 0, 0
    matches, idx = 0, 0
    for s in steps:
        if s in PROCESS_STATES[idx:]:
            matches += 1
            idx = PROCESS_STATES.index(s) + 1
    return matches, len(steps)


def test_trajectory_identity_on_random_runs(spark):
    rnd = random.Random(3)
    rows, expected = [], {}
    t0 = datetime(2024, 1, 1)
    eid = 0
    for loop in range(300):
        n = rnd.randint(1, 30)
        steps = [rnd.choice(PROCESS_STATES + ["UNKNOWN"]) for _ in range(n)]
        expected[f"L{loop}"] = python_trajectory(steps)
        for i, s in enumerate(steps):
            rows.append((f"L{loop}", eid, t0 + timedelta(hours=rnd.randint(0, 24 * 5)) if i % 3 else
                         t0 + timedelta(hours=i), s, "SUCCESS"))
            eid += 1
    # Order is (ts, event_id): recompute the expected walk in that order.
    by_loop = {}
    for r in rows:
        by_loop.setdefault(r[0], []).append(r)
    expected = {k: python_trajectory([r[3] for r in sorted(v, key=lambda r: (r[2], r[1]))]) for k, v in by_loop.items()}
    df = spark.createDataFrame(rows, "loop_id string, event_id long, ts timestamp_ntz, step_name string, status string")
    m = G.trajectory_matches(df).groupBy("loop_id").agg(F.count_if("matched").alias("m"), F.count("*").alias("n"))
    got = {r.loop_id: (r.m, r.n) for r in m.collect()}
    assert got == expected


def test_sandbox_and_spec_scores(spark):
    df = spark.createDataFrame([(None, None), (50.0, 1), (100.0, 0), (100.0, 1)], "r double, c int")
    got = [r.s for r in df.select(G.sandbox_score("r", "c").alias("s")).collect()]
    assert got == [0.0, 0.4, 1.0, 0.8]
    specs = spark.createDataFrame([(None, "finance"), ("", "finance"), ("x", "finance")], "t string, d string")
    g = [r.g for r in specs.select(G.gherkin_score("t", "d").alias("g")).collect()]
    assert g[:2] == [0.0, 0.0] and g[2] == 0.0  # 'x' has >= 4 violations -> 1 - min(1, .25n) = 0
    k = [r.k for r in specs.select(G.skill_score("t", "d").alias("k")).collect()]
    assert k == [0.0, 0.0, 0.1]  # three finance metrics missing -> max(1 - 0.9, 0)


def test_tool_use_and_protocol(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (4,)], "f long")
    assert [r.s for r in df.select(G.tool_use_score("f").alias("s")).collect()] == [1.0, 0.7, 0.4, 0.0]
    resp = spark.createDataFrame([(1, True, True, True, True), (2, False, False, False, False)],
                                 "response_id long, protocol_ok boolean, has_artifacts boolean, "
                                 "correct_domain boolean, lifecycle_ok boolean")
    got = {r.response_id: (r.aggregate_score, r.passed) for r in G.protocol_scorecard(resp).collect()}
    assert got == {1: (1.0, True), 2: (0.23, False)}  # .25*.5 + .2*.5 = .225 -> .23


def test_suites_per_domain_and_in_all(spark):
    schema = "domain string, aggregate_score double, passed boolean"
    reports = {"a": spark.createDataFrame([("sales", 0.9, True), ("sales", 0.81, False), (None, 1.0, True)], schema),
               "b": spark.createDataFrame([("finance", 0.85, True)], schema), "c": spark.createDataFrame([], schema)}
    got = {(r.suite, r.domain): (r.runs, r.mean_aggregate_score, r.all_passed, r.gate_passed) for r in G.suite_summary(reports).collect()}
    assert got == {("a", "sales"): (2, 0.86, False, True), ("a", None): (1, 1.0, True, True), ("a", "ALL"): (3, 0.9, False, True),
                   ("b", "finance"): (1, 0.85, True, True), ("b", "ALL"): (1, 0.85, True, True)}
