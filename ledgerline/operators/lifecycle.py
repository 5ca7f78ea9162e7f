"""Lifecycle analysis of the loop event log.

The event log has one row per processed step: (loop_id, event_id, ts,
step_name, decision, review_outcome, harness_passed).  Ordered per-loop
logic (retry charges, first resolutions, segments) uses running counts
split by ten-minute slices (``functions.windows``), so a hot loop is not one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions.timeutil import epoch_micros
from ..functions.windows import as_of, neighbour, running, slice_of

MAX_RETRIES = 3
MAX_STEPS = 25
TERMINAL_STATES = ["DONE", "CLOSED", "ESCALATED"]
PAUSE_STATES = ["WAIT_GATE_H1", "WAIT_GATE_H2"]
# Review outcome -> retry destination (unknown outcomes retry IMPLEMENT).
REVIEW_DESTINATIONS = [("fail_fix", "IMPLEMENT"), ("fail_design", "DESIGN"),
                       ("fail_definition", "SPECIFY"), ("fail_spec", "SPECIFY")]
LINEAR_EDGES = [("INTAKE", "SPECIFY"), ("SPECIFY", "SPEC_HARNESS"), ("DESIGN", "IMPLEMENT"),
                ("IMPLEMENT", "REVIEW"), ("CLOSE", "WATCH"), ("WATCH", "DONE")]


def _review_destination(outcome: Column) -> Column:
    chain = None
    for o, dest in REVIEW_DESTINATIONS:
        chain = F.when(outcome == o, dest) if chain is None else chain.when(outcome == o, dest)
    return chain.otherwise("IMPLEMENT")


def _charges(events: DataFrame) -> DataFrame:
    """Every event with its retry ``destination`` (NULL when it charges
    nothing) and whether the charge is capped (failures) or not (gate
    "request changes")."""
    st = F.col("step_name")
    harness_fail = (st == "SPEC_HARNESS") & ~F.coalesce(F.col("harness_passed"), F.lit(False))
    review_fail = (st == "REVIEW") & (F.coalesce(F.col("review_outcome"), F.lit("pass")) != "pass")
    h1_changes = (st == "GATE_H1") & (F.col("decision") == "request_changes")
    h2_changes = (st == "GATE_H2") & (F.col("decision") == "request_changes")
    dest = (F.when(harness_fail | h1_changes, "SPECIFY")
            .when(review_fail, _review_destination(F.col("review_outcome")))
            .when(h2_changes, "IMPLEMENT"))
    return events.withColumn("destination", dest).withColumn("capped", harness_fail | review_fail)


def _with_budget(events: DataFrame, charging_only: bool = False) -> DataFrame:
    """Events with ``escalated`` and ``charges`` (retries charged before, for
    the same loop and destination).  A capped failure escalates once 3 charges
    exist and then charges nothing.  So the first three events of a (loop,
    destination) charge, and after them the uncapped ones: beyond three,
    ``charges`` is the number of earlier uncapped events plus that of the
    capped among the first three.  One pass gives all of it: per slice the
    number of events, of uncapped ones and its first three.  Non-charging
    events form their own (loop, '') groups and are ignored, or left out."""
    keys, order = ["loop_id", "_dest"], ["ts", "event_id"]
    c = (_charges(events).withColumn("slice", slice_of("ts"))
         .withColumn("_dest", F.coalesce(F.col("destination"), F.lit(""))))  # non-NULL key
    c = c.filter(F.col("destination").isNotNull()) if charging_only else c
    inside = Window.partitionBy(*keys, "slice").orderBy(*order)
    free, first = ~F.col("capped"), F.row_number().over(inside)
    heads = c.filter(F.col("destination").isNotNull()).select(*keys, "slice", "capped", first.alias("_nth"))
    capped = [F.max((F.col("capped") & (F.col("_nth") == k)).cast("int")) for k in range(1, MAX_RETRIES + 1)]
    slices = heads.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("_n"), F.count_if(free).alias("_u"), F.array(*capped).alias("_first"))
    earlier_slices = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, "slice", "_first", *[F.coalesce(F.sum(n).over(earlier_slices), F.lit(0)).alias(f"{n}0") for n in ("_n", "_u")])
    missing = F.greatest(F.lit(MAX_RETRIES) - F.col("_n0"), F.lit(0)).cast("int")  # of the first three, still to come
    among = sum((F.when(missing >= k, F.col("_first")[k - 1]).otherwise(0) for k in range(1, MAX_RETRIES + 1)), F.lit(0))
    slices = slices.select(*keys, "slice", "_n0", "_u0", F.sum(among).over(Window.partitionBy(*keys)).alias("_capped"))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = c.withColumn("_n", F.count(F.lit(1)).over(before)).withColumn("_u", F.count_if(free).over(before))
    out = rows.join(slices, [*keys, "slice"], "left")
    earlier = F.col("_n0") + F.col("_n")
    charging = F.col("destination").isNotNull()
    out = out.withColumn("escalated", F.coalesce(charging & F.col("capped") & (earlier >= MAX_RETRIES), F.lit(False)))
    out = out.withColumn("charges", F.when(charging, F.when(earlier <= MAX_RETRIES, earlier).otherwise(F.col("_u0") + F.col("_u") + F.col("_capped"))))
    return out.drop("slice", "_dest", "_n", "_u", "_n0", "_u0", "_capped")


# F9 in I1/I2: what the harness said
def escalation_violations(events: DataFrame, reports: DataFrame) -> DataFrame:
    """``loop_id, event_id, found``: the violations of the loop's newest
    harness report at each failed harness step (NULL without a report)."""
    failed = (F.col("step_name") == "SPEC_HARNESS") & ~F.coalesce(F.col("harness_passed"), F.lit(False))
    steps = events.filter(failed).select("loop_id", "event_id", "ts")
    return as_of(steps, reports, ["loop_id"], "violations", "found").select("loop_id", "event_id", "found")


def _harness_reason(found: Column) -> Column:
    listed = F.coalesce(F.array_join(found, ", "), F.lit("Unknown violations"))
    return F.concat(F.lit(f"Spec harness validation failed after {MAX_RETRIES} retries. Violations: "), listed)


def _with_found(rows: DataFrame, events: DataFrame, reports: DataFrame | None) -> DataFrame:
    if reports is None:
        return rows.withColumn("found", F.lit(None).cast("array<string>"))
    return rows.join(escalation_violations(events, reports), ["loop_id", "event_id"], "left")


def _reason(escalated: Column, destination: Column) -> Column:
    """Why an event escalated."""
    return (F.when(escalated & (F.col("step_name") == "SPEC_HARNESS"), _harness_reason(F.col("found")))
            .when(escalated, F.concat(F.lit("Reviewer returned '"), F.col("review_outcome"),
                                      F.lit(f"' and retry limit ({MAX_RETRIES}) for node '"), destination, F.lit("' was reached."))))


# I2
def retry_budget(events: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Per charge event: retries charged before it for its destination, and
    whether it escalates, with the reason; ``reports`` (loop_id, event_id, ts,
    violations) are the harness reports that the reason lists."""
    c = _with_found(_with_budget(events, charging_only=True), events, reports)
    escalated = F.col("escalated")
    return c.select("loop_id", "event_id", "step_name", "destination",
                    F.col("charges").cast("long").alias("charges_before"),
                    (~escalated).alias("charged"), escalated.alias("escalated"), _reason(escalated, F.col("destination")).alias("reason"))


# I3
def total_retries(budget: DataFrame) -> DataFrame:
    return budget.groupBy("loop_id").agg(F.count_if("charged").alias("total_retries"))


# I1
def transitions(events: DataFrame) -> DataFrame:
    """Next state per event from the routing rules; retry caps come from the
    running charge count computed on the same frame (no join back)."""
    return _routed(_with_budget(events)).select("loop_id", "event_id", "ts", "step_name", "next_state")


def next_state(events: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Transitions with the reason of those that end or escalate a loop
    without its being done."""
    e = _with_found(_routed(_with_budget(events)), events, reports)
    rejected = F.col("step_name").isin("GATE_H1", "GATE_H2") & (F.col("next_state") == "CLOSED")
    gate = F.when(F.col("step_name") == "GATE_H1", "Gate H1").otherwise("Gate H2")
    reason = (F.when(rejected, F.concat(gate, F.lit(" rejected by human reviewer ("), F.col("reviewer"), F.lit(").")))
              .otherwise(_reason((F.col("next_state") == "ESCALATED") & F.col("escalated"), F.col("destination"))))
    return e.select("loop_id", "event_id", "ts", "step_name", "next_state", reason.alias("reason"))


def _routed(e: DataFrame) -> DataFrame:
    """``next_state`` of events with their retry budget."""
    st, dec = F.col("step_name"), F.col("decision")
    esc = F.coalesce(F.col("escalated"), F.lit(False))
    outcome = F.coalesce(F.col("review_outcome"), F.lit("pass"))
    chain = None
    for a, b in LINEAR_EDGES:
        chain = F.when(st == a, b) if chain is None else chain.when(st == a, b)
    chain = (chain
             .when(st == "SPEC_HARNESS", F.when(F.coalesce(F.col("harness_passed"), F.lit(False)), "GATE_H1")
                   .when(esc, "ESCALATED").otherwise("SPECIFY"))
             .when(st == "GATE_H1", F.when(dec.isNull(), "WAIT_GATE_H1").when(dec == "approve", "DESIGN")
                   .when(dec == "request_changes", "SPECIFY").otherwise("CLOSED"))
             .when(st == "REVIEW", F.when(outcome == "pass", "GATE_H2").when(esc, "ESCALATED")
                   .otherwise(_review_destination(outcome)))
             .when(st == "GATE_H2", F.when(dec.isNull(), "WAIT_GATE_H2").when(dec == "approve", "CLOSE")
                   .when(dec == "request_changes", "REVIEW").otherwise("CLOSED"))
             .otherwise(st))
    return e.withColumn("next_state", chain)


# I4
def first_gate_resolution(events: DataFrame) -> DataFrame:
    g = (events.filter(F.col("decision").isNotNull())
         .select("loop_id", "event_id", "ts", F.col("step_name").alias("gate"), "decision")
         .withColumn("slice", slice_of("ts")))
    g = running(g, ["loop_id", "gate"], "slice", ["ts", "event_id"], F.lit(1), "resolution_rank")
    return g.select("loop_id", "event_id", "gate", "decision", F.col("resolution_rank").cast("long"),
                    F.when(F.col("resolution_rank") == 1, "EFFECTIVE").otherwise("CONFLICT").alias("status"))


# I5
def latest_loop_state(transitions: DataFrame) -> DataFrame:
    """Last write per loop wins: state after the loop's newest event."""
    key = F.struct("ts", "event_id")
    return transitions.groupBy("loop_id").agg(
        F.max_by("next_state", key).alias("current_state"), F.max("ts").alias("updated_at"))


# I6
def pending_gates(latest: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Category of every loop and the age of its pending gate, as of the
    newest event (of ``events``, which is cheaper to read than the states)."""
    now = (latest.select(F.max("updated_at")) if events is None else events.select(F.max("ts"))).scalar()
    age_us = epoch_micros(now) - epoch_micros("updated_at")
    category = (F.when(F.col("current_state").isin(PAUSE_STATES), "PENDING_GATE")
                .when(F.col("current_state").isin(TERMINAL_STATES), "TERMINAL").otherwise("ACTIVE"))
    return latest.select(
        "loop_id", "current_state", category.alias("category"),
        F.when(F.col("current_state").isin(PAUSE_STATES),
               fx.half_up_ratio(age_us, F.lit(3_600_000_000), 0, 100) / F.lit(100.0)).alias("age_hours"))


# I7
def step_limit(transitions: DataFrame, limit: int = MAX_STEPS) -> DataFrame:
    """Runs of consecutive steps of a loop up to (and including) a pause or
    terminal state, with their length; a run of at least ``limit`` steps is
    escalated by the step limit (``escalated``)."""
    stop = F.col("next_state").isin(PAUSE_STATES + TERMINAL_STATES).cast("int")
    t = transitions.withColumn("stop", stop).withColumn("slice", slice_of("ts"))
    t = running(t, ["loop_id"], "slice", ["ts", "event_id"], "stop", "segment", inclusive=False)
    g = t.groupBy("loop_id", "segment").agg(F.count(F.lit(1)).alias("steps"))
    return g.select("loop_id", F.col("segment").cast("long").alias("segment"), "steps",
                    (F.col("steps") >= limit).alias("escalated"))


# I8
def stage_durations(events: DataFrame) -> DataFrame:
    """Time from each step to the next step of the loop, per state (gate
    states give the gate wait)."""
    us = epoch_micros("ts")
    t = events.select("loop_id", "event_id", "ts", "step_name").withColumn("us", us).withColumn("slice", slice_of("ts"))
    t = neighbour(t, ["loop_id"], "slice", ["ts", "event_id"], "us", "next_us", direction="next")
    d = t.filter(F.col("next_us").isNotNull()).withColumn("dur_us", F.col("next_us") - F.col("us"))
    g = d.groupBy("step_name").agg(F.count(F.lit(1)).alias("transitions"), F.sum("dur_us").alias("_s"),
                                   F.max("dur_us").alias("_m"))
    return g.select("step_name", "transitions",
                    (fx.half_up_ratio("_s", "transitions", 0) / F.lit(1e6)).alias("avg_seconds"),
                    (F.col("_m").cast("double") / F.lit(1e6)).alias("max_seconds"))
