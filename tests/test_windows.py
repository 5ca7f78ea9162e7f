"""The skew-safe running/neighbour helpers equal plain per-key windows."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.windows import neighbour, running


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 30)}"  # one key holds ~40 %
        rows.append((key, i, rnd.randint(0, 10_000), rnd.randint(0, 9)))
    df = spark.createDataFrame(rows, "k string, id long, t long, v long")
    return df.withColumn("b", (F.col("t") / 500).cast("long"))


def test_running_sum_max_match_plain_window(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = (df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("m", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    got = running(df, ["k"], "b", ["t", "id"], "v", "s", "sum", True)
    got = running(got, ["k"], "b", ["t", "id"], "v", "m", "max", False)
    e = {r.id: (r.s, r.m) for r in exp.collect()}
    g = {r.id: (r.s, r.m) for r in got.collect()}
    assert e == g


def test_neighbours_match_lag_lead(spark):
    df = _data(spark, seed=11)
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = df.withColumn("p", F.lag("t").over(w)).withColumn("n", F.lead("t").over(w))
    got = neighbour(df, ["k"], "b", ["t", "id"], "t", "p", "prev")
    got = neighbour(got, ["k"], "b", ["t", "id"], "t", "n", "next")
    assert {r.id: (r.p, r.n) for r in exp.collect()} == {r.id: (r.p, r.n) for r in got.collect()}


def test_running_descending_min_matches_following_frame(spark):
    df = _data(spark, seed=5)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(1, Window.unboundedFollowing)
    exp = df.withColumn("f", F.min(F.struct("t", "id")).over(w))
    got = running(df, ["k"], "b", ["t", "id"], F.struct("t", "id"), "f", "min", inclusive=False, descending=True)
    assert {r.id: r.f for r in exp.collect()} == {r.id: r.f for r in got.collect()}


def test_row_level_window_is_partitioned_by_key_and_bucket(spark):
    """The hot key is split: the row-level window's partition spec carries
    the bucket, and the big side is shuffled once."""
    import re
    out = running(_data(spark), ["k"], "b", ["t", "id"], "v", "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"windowspecdefinition\(k#\d+L?, b#\d+L?, t#\d+L? ASC", plan)
    assert re.search(r"Exchange hashpartitioning\(k#\d+L?, b#\d+L?", plan)


def test_hot_key_in_one_day_is_split_and_carried(spark):
    """A third of the rows share one key and one day; slices give the plain
    window's answer and no row-level window groups by the key alone."""
    from ledgerline.functions import windows as W

    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 40) END AS k", "id",
        "timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 7919) % 86400) AS ts", "id % 10 AS v")
    df = rows.withColumn("slice", W.slice_of("ts"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    exp = (df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("p", F.lag("id").over(w)))
    got = W.neighbour(W.running(df, ["k"], "slice", ["ts", "id"], "v", "s"), ["k"], "slice", ["ts", "id"], "id", "p")
    assert {(r.id, r.s, r.p) for r in exp.collect()} == {(r.id, r.s, r.p) for r in got.collect()}


def test_registered_plans_have_no_row_window_over_a_loop_alone(spark, small):
    import re

    from ledgerline.plans.registry import PLANS

    for name in ("audit_hash", "audit_keys", "audit_integrity", "next_state", "events_for_loop"):
        plan = PLANS[name](small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"windowspecdefinition\(loop_id#\d+L?, ts#", plan), name


def test_newest_value_that_is_not_null(spark):
    df = _data(spark, seed=3).withColumn("x", F.when(F.col("v") > 7, F.col("id")))
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = (df.withColumn("l", F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("n", F.first("x", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))))
    got = running(df, ["k"], "b", ["t", "id"], "x", "l", "last")
    got = running(got, ["k"], "b", ["t", "id"], "x", "n", "last", inclusive=False, descending=True)
    assert {r.id: (r.l, r.n) for r in exp.collect()} == {r.id: (r.l, r.n) for r in got.collect()}


def test_as_of_equals_a_search_of_all_facts(spark):
    """Facts before, at and after events, ties, null values, a hot key."""
    from ledgerline.functions.windows import as_of

    rnd = random.Random(9)

    def rows(n, first):
        return [("hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 12)}", first + i, rnd.randint(0, 200)) for i in range(n)]

    events, facts = rows(400, 0), [(*r, rnd.choice([None, r[1], -r[1]])) for r in rows(300, 1000)]

    def ts(df):
        return df.withColumn("ts", F.expr("timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(0, 0, t)"))

    got = {r.event_id: r.x for r in as_of(
        ts(spark.createDataFrame(events, "k string, event_id long, t int")),
        ts(spark.createDataFrame(facts, "k string, event_id long, t int, v long")), ["k"], "v", "x").collect()}
    assert len(got) == 400
    for k, i, t in events:
        past = [(ft, fi, v) for fk, fi, ft, v in facts if fk == k and ft <= t]
        assert got[i] == (max(past, key=lambda p: p[:2])[2] if past else None), i


def test_plans_read_the_events_a_bounded_number_of_times(small):
    from ledgerline.plans.registry import PLANS

    for name, most in (("latest_loop_state", 2), ("total_retries", 2), ("stage_durations", 2), ("first_gate_resolution", 2),
                       ("step_limit", 4), ("retry_budget", 6)):
        plan = PLANS[name](small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most, name
