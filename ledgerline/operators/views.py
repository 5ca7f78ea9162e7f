"""Domain views B1-B20: DataFrame(s) -> DataFrame, lazy, no UDFs.

B1-B5 keep the delivered views' exact semantics, fan-outs included.
``computed_at`` (CURRENT_TIMESTAMP) is optional and off by default so that
results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions.joins import broadcast_fixed
from ..functions.timeutil import epoch_micros, trunc_date, trunc_ntz
from ..functions.windows import SLICE_MICROS, neighbour, running_many, slice_of


def _computed_at(df: DataFrame, with_ts: bool) -> DataFrame:
    return df.withColumn("computed_at", F.current_timestamp()) if with_ts else df


def exact_avg(value: str, scale: int = 4) -> F.Column:
    """avg(value) HALF_UP to ``scale`` places, exact; rounded once, at the end."""
    return fx.fine_avg(value, scale)


def money_sum(value: str) -> F.Column:
    """Exact decimal sum returned as double."""
    return F.sum(F.col(value).cast("decimal(18,2)")).cast("double")


# B1 ------------------------------------------------------------------------
def weekly_revenue_variance(invoices: DataFrame, rates: DataFrame, with_ts: bool = False) -> DataFrame:
    """PAID invoices LEFT JOIN EUR rates on currency only (one row per
    matching rate, as delivered), rate defaults to 1.0."""
    r = rates.filter(F.col("base_currency") == "EUR").select("target_currency", "rate")
    out = (invoices.filter(F.col("status") == "PAID")
           .join(r, F.col("currency") == F.col("target_currency"), "left")
           .select("invoice_id", "account_id",
                   F.col("amount").cast("double").alias("amount_original"),
                   F.col("currency").alias("currency_original"),
                   F.coalesce(F.col("rate"), F.lit(1.0)).alias("exchange_rate"),
                   fx.convert_currency("amount", F.coalesce(F.col("rate"), F.lit(1.0))).alias("amount_usd")))
    return _computed_at(out, with_ts)


# B2 ------------------------------------------------------------------------
def sales_pipeline_conversion(opps: DataFrame, with_ts: bool = False) -> DataFrame:
    out = opps.groupBy("stage").agg(
        F.count("opp_id").alias("total_opportunities"),
        money_sum("amount_eur").alias("total_pipeline_eur"),
        exact_avg("amount_eur", 2).alias("avg_deal_size_eur"))
    return _computed_at(out, with_ts)


# B3 ------------------------------------------------------------------------
def charger_telemetry_agg(telemetry: DataFrame, with_ts: bool = False) -> DataFrame:
    out = telemetry.groupBy("charger_id", "firmware_version").agg(
        exact_avg("voltage").alias("avg_voltage"),
        exact_avg("current_amperes").alias("avg_current"),
        F.max("temperature_celsius").alias("max_temperature"))
    return _computed_at(out, with_ts)


# B4 ------------------------------------------------------------------------
def campaign_attribution(events: DataFrame, acquisitions: DataFrame, with_ts: bool = False) -> DataFrame:
    """Same result as ``events JOIN acquisitions USING (campaign_id) WHERE
    Purchase GROUP BY channel`` without building the product rows: both
    sides are pre-aggregated per campaign and multiplied."""
    purchases = events.filter(F.col("event_type") == "Purchase")
    def wide(name: str) -> F.Column:  # the product grows with the square of the data
        return F.col(name).cast("decimal(19,0)")

    acq = acquisitions.groupBy("campaign_id").agg(
        F.sum(fx.cents("cac_usd")).alias("acq_cents"),
        F.count("cac_usd").alias("acq_n"))
    ev = purchases.groupBy("campaign_id", "channel").agg(F.count(F.lit(1)).alias("ev_n"))
    totals = (ev.join(acq, "campaign_id")
              .groupBy("channel")
              .agg(F.sum(wide("ev_n") * wide("acq_cents")).alias("cents"),
                   F.sum(wide("ev_n") * wide("acq_n")).alias("n")))
    users = (purchases.join(acq.select("campaign_id"), "campaign_id", "left_semi")
             .groupBy("channel").agg(F.countDistinct("user_id_hashed").alias("unique_conversions")))
    out = users.join(totals, "channel").select(
        "channel", "unique_conversions",
        (F.col("cents").cast("double") / F.lit(100.0)).alias("total_cac_usd"),
        fx.cac("cents", "n").alias("avg_cac_usd"))
    return _computed_at(out, with_ts)


# B5 ------------------------------------------------------------------------
def inventory_turnover_view(inventory: DataFrame, dispatch: DataFrame, with_ts: bool = False) -> DataFrame:
    d = dispatch.select("order_id", "dispatch_time_hours", "sla_target_hours")
    out = (inventory.join(d, inventory["part_id"] == d["order_id"], "left")
           .select("part_id", "warehouse_id", "quantity_on_hand", "reorder_point",
                   "dispatch_time_hours", "sla_target_hours",
                   F.when(fx.dispatch_sla_met("dispatch_time_hours", "sla_target_hours"), 1)
                   .otherwise(0).alias("on_time_flag")))
    return _computed_at(out, with_ts)


# B6 ------------------------------------------------------------------------
def rate_calendar(rates: DataFrame, until: F.Column) -> DataFrame:
    """``currency, day, rate, first_rate``: the EUR rate in force on each day
    from the currency's first rate to ``until`` (a scalar), and its first
    rate.  Its size follows the rates and the days, not the invoices."""
    r = (rates.filter(F.col("base_currency") == "EUR")
         .groupBy("target_currency", "rate_date").agg(F.max("rate").alias("rate")))
    w = Window.partitionBy("target_currency").orderBy("rate_date")
    end = F.coalesce(F.date_sub(F.lead("rate_date").over(w), 1), F.greatest("rate_date", until))
    return (r.withColumn("end", end).withColumn("first_rate", F.first("rate").over(w))
            .select(F.col("target_currency").alias("currency"), "rate", "first_rate",
                    F.explode(F.sequence("rate_date", "end")).alias("day")))


def with_usd_rates(invoices: DataFrame, rates: DataFrame, date_col: str = "issue_date") -> DataFrame:
    """Each invoice with the EUR rates in force on its date: of its currency
    (``own_rate``, ``own_first``) and of USD (``usd_rate``, ``usd_first``); NULL
    where no rate is in force yet.  An as-of join as two equi-joins on days;
    which side is broadcast is left to the planner."""
    until = invoices.select(F.max(date_col)).scalar()
    calendar = rate_calendar(rates, until)
    own = calendar.select("currency", F.col("day").alias(date_col), F.col("rate").alias("own_rate"),
                          F.col("first_rate").alias("own_first"))
    usd = calendar.filter(F.col("currency") == "USD").select(
        F.col("day").alias(date_col), F.col("rate").alias("usd_rate"), F.col("first_rate").alias("usd_first"))
    return invoices.join(own, ["currency", date_col], "left").join(usd, date_col, "left")


def weekly_fx_variance(invoices: DataFrame, rates: DataFrame) -> DataFrame:
    """USD amounts of PAID invoices per week and currency at the rates in
    force and at each currency's first rate; invoices without a rate are
    counted, not converted."""
    paid = invoices.filter(F.col("status") == "PAID")
    j = (with_usd_rates(paid, rates)
         .withColumn("week_start", trunc_date("week", "issue_date"))
         .withColumn("usd", fx.to_usd("amount", "currency", "own_rate", "usd_rate"))
         .withColumn("fixed_usd", F.when(F.col("usd").isNotNull(),
                                         fx.to_usd("amount", "currency", "own_first", "usd_first"))))
    g = j.groupBy("week_start", "currency").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.count_if(F.col("usd").isNull()).alias("without_rate"),
        money_sum("amount").alias("amount_original"),
        money_sum("usd").alias("amount_usd"),
        money_sum("fixed_usd").alias("amount_usd_fixed_rate"))
    return g.withColumn("variance", fx.pct_variance("amount_usd_fixed_rate", "amount_usd"))


# B7 ------------------------------------------------------------------------
def monthly_pipeline_by_stage(opps: DataFrame) -> DataFrame:
    return (opps.withColumn("month", trunc_date("month", "close_date"))
            .groupBy("month", "stage")
            .agg(F.count("opp_id").alias("opportunities"), money_sum("amount_eur").alias("pipeline_eur")))


# B8 ------------------------------------------------------------------------
def hourly_error_telemetry(errors: DataFrame, telemetry: DataFrame) -> DataFrame:
    e = (errors.withColumn("hour", trunc_ntz("hour", "log_timestamp"))
         .groupBy("hour").agg(
             F.count(F.lit(1)).alias("error_count"),
             F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
             F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
             F.count_if(F.col("severity") == "INFO").alias("info_count")))
    t = (telemetry.withColumn("hour", trunc_ntz("hour", "event_timestamp"))
         .groupBy("hour").agg(
             F.count(F.lit(1)).alias("readings"),
             exact_avg("temperature_celsius").alias("avg_temperature"),
             F.max("temperature_celsius").alias("max_temperature")))
    j = e.join(t, "hour", "full_outer")
    return j.select(
        "hour",
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
        F.coalesce("info_count", F.lit(0)).alias("info_count"),
        F.coalesce("readings", F.lit(0)).alias("readings"),
        "avg_temperature", "max_temperature")


# B10 -----------------------------------------------------------------------
def reorder_alert(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        "part_id", "warehouse_id", "quantity_on_hand", "reorder_point",
        F.when(F.col("quantity_on_hand") <= F.col("reorder_point"), "REORDER")
        .otherwise("OPTIMAL").alias("stock_status"))


# B11 -----------------------------------------------------------------------
def dispatch_sla_adherence(dispatch: DataFrame) -> DataFrame:
    on_time = fx.dispatch_sla_met("dispatch_time_hours", "sla_target_hours")
    g = dispatch.groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("dispatches"),
        F.count_if(on_time).alias("on_time"))
    return g.withColumn("dispatch_sla_adherence_pct", fx.half_up_ratio("on_time", "dispatches", 2, 100))


# B12 -----------------------------------------------------------------------
RECONCILIATION_TOLERANCE = 0.05


def reconciliation_status(weekly: DataFrame, tolerance: float = RECONCILIATION_TOLERANCE) -> DataFrame:
    """``weekly`` is :func:`weekly_fx_variance`; status per week, totals per currency."""
    flagged = F.abs(F.col("variance")) > F.lit(tolerance)
    s = weekly.withColumn("status", F.when(flagged, "FLAGGED_REVIEW").otherwise("RECONCILED"))
    return s.groupBy("currency").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.count_if(F.col("status") == "RECONCILED").alias("reconciled_weeks"),
        F.count_if(F.col("status") == "FLAGGED_REVIEW").alias("flagged_weeks"),
        F.sum(F.when(flagged, F.col("amount_usd").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)")))
        .cast("double").alias("unreconciled_usd"))


# B13 -----------------------------------------------------------------------
def revenue_summary(invoices: DataFrame) -> DataFrame:
    return (invoices.filter(F.col("status") == "PAID")
            .groupBy("issue_date", "currency")
            .agg(money_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("invoice_count")))


# B14 -----------------------------------------------------------------------
def charger_health(telemetry: DataFrame, errors: DataFrame) -> DataFrame:
    t = telemetry.groupBy("charger_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.max("temperature_celsius").alias("max_temperature"))
    e = errors.groupBy("charger_id").agg(F.count(F.lit(1)).alias("error_count"))
    j = t.join(e, "charger_id", "left").withColumn("error_count", F.coalesce("error_count", F.lit(0)))
    return j.select(
        "charger_id", "total_events", "error_count",
        fx.half_up_ratio("error_count", "total_events", 4).alias("error_frequency"),
        "max_temperature",
        fx.safe_temperature("max_temperature").alias("is_safe"))


# B15 -----------------------------------------------------------------------
def telemetry_ingestion_delay(telemetry: DataFrame) -> DataFrame:
    """Gap (ms) from each reading to the previous reading of the charger;
    avg (3 dp, HALF_UP) and max per charger.  The previous reading is found
    per (charger, slice) with a carry from earlier slices, so one hot charger
    does not collapse into one task."""
    us = epoch_micros("event_timestamp")
    t = (telemetry.select("charger_id", "reading_id", "event_timestamp")
         .withColumn("us", us)
         .withColumn("slice", slice_of("event_timestamp")))
    t = neighbour(t, ["charger_id"], "slice", ["event_timestamp", "reading_id"], "us", "prev_us")
    gaps = t.filter(F.col("prev_us").isNotNull()).withColumn("gap_us", F.col("us") - F.col("prev_us"))
    g = gaps.groupBy("charger_id").agg(
        F.count(F.lit(1)).alias("gaps"),
        F.sum("gap_us").alias("sum_us"),
        F.max("gap_us").alias("max_us"))
    return g.select(
        "charger_id", "gaps",
        (fx.half_up_ratio("sum_us", "gaps", 0) / F.lit(1000.0)).alias("avg_delay_ms"),
        (F.col("max_us").cast("double") / F.lit(1000.0)).alias("max_delay_ms"))


# B16 -----------------------------------------------------------------------
def channel_cac(ad_spend: DataFrame, acquisitions: DataFrame, events: DataFrame) -> DataFrame:
    spend = ad_spend.groupBy("channel").agg(F.sum(fx.cents("amount_usd")).alias("spend_cents"))
    campaign_channel = events.select("campaign_id", "channel").distinct()
    acq = (acquisitions.join(campaign_channel, "campaign_id")
           .groupBy("channel").agg(F.count(F.lit(1)).alias("acquisitions")))
    j = (spend.join(acq, "channel", "full_outer")
         .withColumn("spend_cents", F.coalesce("spend_cents", F.lit(0)))
         .withColumn("acquisitions", F.coalesce("acquisitions", F.lit(0))))
    return j.select(
        "channel",
        (F.col("spend_cents").cast("double") / F.lit(100.0)).alias("spend_usd"),
        "acquisitions",
        fx.cac("spend_cents", "acquisitions").alias("cac_usd"))


# B17 -----------------------------------------------------------------------
# Stage weights of the weighted pipeline (our choice, see the survey).
STAGE_WEIGHTS = [("Prospecting", "0.1"), ("Qualified", "0.3"), ("Negotiation", "0.6"),
                 ("Won", "1.0"), ("Lost", "0.0")]


def stage_weights(spark) -> DataFrame:
    return spark.createDataFrame(
        [(s, w) for s, w in STAGE_WEIGHTS], "stage string, weight string"
    ).select("stage", F.col("weight").cast("decimal(3,1)").alias("weight"))


def weighted_pipeline(opps: DataFrame) -> DataFrame:
    weights = broadcast_fixed(stage_weights(opps.sparkSession))
    j = opps.join(weights, "stage", "left")
    return j.groupBy("stage").agg(
        F.max(F.col("weight")).cast("double").alias("weight"),
        money_sum("amount_eur").alias("pipeline_eur"),
        F.sum(F.col("amount_eur") * F.coalesce(F.col("weight"), F.lit(0).cast("decimal(3,1)")))
        .cast("double").alias("weighted_eur"))


# B18 -----------------------------------------------------------------------
FUNNEL_STEPS = ["Impression", "Click", "Signup", "Purchase"]


def funnel_conversion(events: DataFrame) -> DataFrame:
    """Distinct users reaching each step; rate vs the previous step (pct)."""
    per_user = events.groupBy("user_id").agg(
        *[F.max(F.when(F.col("event_type") == s, 1).otherwise(0)).alias(f"s{i}")
          for i, s in enumerate(FUNNEL_STEPS)])
    totals = per_user.agg(*[F.sum(f"s{i}").alias(f"n{i}") for i in range(len(FUNNEL_STEPS))])
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"),
                 F.col(f"n{i}").alias("users"),
                 (F.col(f"n{i - 1}") if i else F.col(f"n{i}")).alias("prev"))
        for i, s in enumerate(FUNNEL_STEPS)])
    out = totals.select(F.inline(rows))
    return out.select("step_no", "step", F.col("users").cast("long").alias("users"),
                      fx.half_up_ratio("users", "prev", 2, 100).alias("step_rate_pct"))


# B19 -----------------------------------------------------------------------
def cohort_retention(events: DataFrame) -> DataFrame:
    wk = events.select("user_id", trunc_date("week", "event_timestamp").alias("week")).distinct()
    first = wk.groupBy("user_id").agg(F.min("week").alias("cohort_week"))
    j = wk.join(first, "user_id")
    return (j.withColumn("weeks_since", (F.datediff("week", "cohort_week") / 7).cast("int"))
            .groupBy("cohort_week", "weeks_since").agg(F.count(F.lit(1)).alias("active_users")))


# B20 -----------------------------------------------------------------------
def energy_billing(billing: DataFrame) -> DataFrame:
    return (billing.withColumn("day", F.to_date("event_timestamp"))
            .groupBy("account_id", "charger_id", "day")
            .agg(F.count(F.lit(1)).alias("sessions"), fx.fine_sum("kwh_consumed", 2).alias("kwh")))


# B9 ------------------------------------------------------------------------
TOUCH_TYPES = ["Click", "Impression"]
DAY_US = 86_400_000_000


def touch_shares(events: DataFrame, lookback_days: int = 30) -> DataFrame:
    """Shares of the touches in each purchase: one row per purchase and channel
    with a touch, ``c`` of the purchase's ``n`` touches, the purchase's time
    ``p_x`` (epoch micros) and whether the channel holds the first touch.
    Touches (Click/Impression) of the purchasing user with time in (purchase -
    lookback, purchase] count.

    No touch x purchase pairs are built.  For every purchase and every
    channel the user has touches in, two query points (p - lookback and p)
    are merged into the user's touch timeline of that channel; one ordered
    pass per (user, channel, slice) gives at each query point the number of
    touches up to it and the first touch after it.  Touches in the window =
    difference of the two counts; the purchase total is the sum over
    channels and the first touch the earliest of the per-channel firsts.
    """
    window_us = lookback_days * DAY_US
    us = epoch_micros("event_timestamp")
    ev = events.select("event_id", "user_id", "channel", "event_type", us.alias("x"))
    touches = ev.filter(F.col("event_type").isin(TOUCH_TYPES)).select(
        "user_id", "channel", "x", F.col("event_id").alias("touch_id"))
    purchases = ev.filter(F.col("event_type") == "Purchase").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("x").alias("p_x"))
    # Channels are few per user: pair each purchase with its user's channels.
    user_channels = touches.select("user_id", "channel").distinct()
    q = purchases.join(user_channels, "user_id")
    points = q.select("user_id", "channel", "purchase_id", F.explode(F.array(
        F.struct(F.col("p_x").alias("x"), F.lit(True).alias("hi")),
        F.struct((F.col("p_x") - F.lit(window_us)).alias("x"), F.lit(False).alias("hi")))).alias("pt"))
    pts = (touches.select("user_id", "channel", "x", F.lit(0).alias("kind"), "touch_id",
                          F.lit(None).cast("long").alias("purchase_id"), F.lit(None).cast("boolean").alias("hi"))
           .unionByName(points.select("user_id", "channel", F.col("pt.x").alias("x"), F.lit(1).alias("kind"),
                                      F.lit(None).cast("long").alias("touch_id"), "purchase_id",
                                      F.col("pt.hi").alias("hi")))
           .withColumn("slice", F.floor(F.col("x") / F.lit(SLICE_MICROS))))
    order = ["x", "kind", "touch_id"]
    keys = ["user_id", "channel"]
    # One pass: touches at or before each row (touches sort before queries at
    # equal time) and the first touch strictly after each row.
    pts = running_many(pts, keys, "slice", order, [
        ("upto", (F.col("kind") == 0).cast("long"), "sum", True, False),
        ("next_touch", F.when(F.col("kind") == 0, F.struct("x", "touch_id")), "min", False, True)])
    qc = (pts.filter(F.col("kind") == 1).groupBy("user_id", "channel", "purchase_id").agg(
        F.max(F.when(F.col("hi"), F.col("x"))).alias("p_x"),
        F.max(F.when(F.col("hi"), F.col("upto"))).alias("hi_n"),
        F.max(F.when(~F.col("hi"), F.col("upto"))).alias("lo_n"),
        F.max(F.when(~F.col("hi"), F.col("next_touch"))).alias("first"))
        .withColumn("c", F.col("hi_n") - F.col("lo_n"))
        .filter(F.col("c") > 0))
    # Per purchase (a handful of channel rows): total and earliest first touch.
    wp = Window.partitionBy("purchase_id")
    return qc.select("purchase_id", "channel", "p_x", "c", F.sum("c").over(wp).alias("n"),
                     (F.col("first") == F.min("first").over(wp)).alias("is_first"))


def multi_touch_attribution(events: DataFrame, lookback_days: int = 30) -> DataFrame:
    """Linear multi-touch attribution: the touches before a purchase share it
    equally; the earliest of them is the first touch."""
    per_channel = touch_shares(events, lookback_days).groupBy("channel").agg(
        F.sum("c").alias("window_touches"),
        F.sum(F.col("c") / F.col("n")).alias("credit"),
        F.count_if("is_first").alias("first_touch_purchases"))
    # Each purchase has exactly one first touch: the total over the (few)
    # channel rows is the number of purchases with a touch.
    total = per_channel.select(F.sum("first_touch_purchases")).scalar()
    out = per_channel.withColumn("purchases", total)
    return out.select(
        "channel", "window_touches",
        F.round("credit", 6).alias("touch_credit"),
        F.round(F.col("credit") * 100 / F.col("purchases"), 4).alias("credit_share_pct"),
        "first_touch_purchases",
        fx.half_up_ratio("first_touch_purchases", "purchases", 2, 100).alias("first_touch_pct"))


CREDIT_UNITS = 10 ** 12  # a purchase in the units in which credits are added


def daily_credits(shares: DataFrame) -> DataFrame:
    """Exact credits per channel, day of purchase and number of touches ``n``:
    ``touches`` n-ths of a purchase.  As whole numbers over their denominator
    they lose nothing: over all channels the touches of an ``n`` are ``n``
    times its purchases."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(F.col("p_x") / F.lit(DAY_US)).cast("int"))
    return shares.groupBy("channel", day.alias("day"), "n").agg(F.sum("c").alias("touches"))


def attributed_cac(events: DataFrame, ad_spend: DataFrame, lookback_days: int = 30) -> DataFrame:
    """Cost of an attributed purchase per channel: the channel's spend by its
    fractional credits, in all (``cac_usd``) and over the days on which it earned
    credit (``credited_cac_usd``); the spend of the other days is ``idle_usd``.

    No touch is paired with a purchase and no purchase with spend: credits are
    whole numbers per (channel, day, n), turned into 1e-12 purchases once per
    such group, and meet the spend per (channel, day)."""
    n, touches = F.col("n").cast("decimal(38,0)"), F.col("touches").cast("decimal(20,0)")
    units = fx.idiv(touches * F.lit(CREDIT_UNITS), n).cast("decimal(38,0)")
    credit = daily_credits(touch_shares(events, lookback_days)).groupBy("channel", "day").agg(F.sum(units).alias("units"))
    spend = ad_spend.groupBy("channel", F.col("spend_date").alias("day")).agg(F.sum(fx.cents("amount_usd")).alias("cents"))
    days = credit.join(spend, ["channel", "day"], "full").groupBy("channel").agg(
        F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        F.coalesce(F.sum(F.when(F.col("units") > 0, F.col("cents"))), F.lit(0)).alias("credited"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.count_if(F.col("units") > 0).alias("credit_days"))

    def dollars(cents: Column) -> Column:
        return cents.cast("double") / F.lit(100.0)

    return days.select(
        "channel", "credit_days", fx.half_up_ratio("units", F.lit(CREDIT_UNITS), 6).alias("credited_purchases"),
        dollars(F.col("cents")).alias("spend_usd"), dollars(F.col("cents") - F.col("credited")).alias("idle_usd"),
        (fx.half_up_ratio("cents", "units", 0, CREDIT_UNITS) / F.lit(100.0)).alias("cac_usd"),
        (fx.half_up_ratio("credited", "units", 0, CREDIT_UNITS) / F.lit(100.0)).alias("credited_cac_usd"))
