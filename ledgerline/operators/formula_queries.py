"""Queries that apply the business formulas (C1-C10) to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions.timeutil import trunc_date
from .views import with_usd_rates


def stage_conversion_rate(opps: DataFrame) -> DataFrame:
    g = (opps.withColumn("month", trunc_date("month", "close_date"))
         .groupBy("month").agg(F.count_if(F.col("stage") == "Won").alias("won"),
                               F.count(F.lit(1)).alias("total")))
    return g.withColumn("conversion_rate_pct", fx.stage_conversion_rate("won", "total"))


def mask_account_names(opps: DataFrame) -> DataFrame:
    return opps.select("opp_id", fx.mask_pii("account_name").alias("account_name_masked"))


def parse_telemetry(telemetry: DataFrame) -> DataFrame:
    return telemetry.select(
        "reading_id", F.col("voltage").cast("double").alias("voltage"),
        F.col("current_amperes").cast("double").alias("current_amperes"),
        fx.power_kw("voltage", "current_amperes").alias("power_kw"))


def safe_temperature(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("reading_id", "temperature_celsius",
                            fx.safe_temperature("temperature_celsius").alias("is_safe"))


def cac_monthly(ad_spend: DataFrame, acquisitions: DataFrame, events: DataFrame) -> DataFrame:
    """Monthly spend per channel over acquisitions of that channel and month."""
    spend = (ad_spend.withColumn("month", trunc_date("month", "spend_date"))
             .groupBy("channel", "month").agg(F.sum(fx.cents("amount_usd")).alias("spend_cents")))
    cc = events.select("campaign_id", "channel").distinct()
    acq = (acquisitions.join(cc, "campaign_id")
           .withColumn("month", trunc_date("month", "converted_at"))
           .groupBy("channel", "month").agg(F.count(F.lit(1)).alias("acquisitions")))
    j = (spend.join(acq, ["channel", "month"], "full_outer")
         .select("channel", "month",
                 F.coalesce("spend_cents", F.lit(0)).alias("spend_cents"),
                 F.coalesce("acquisitions", F.lit(0)).alias("acquisitions")))
    return j.withColumn("cac_usd", fx.cac("spend_cents", "acquisitions"))


def consent_filtered_events(events: DataFrame) -> DataFrame:
    return events.filter(fx.consent_filter("consent_granted")).select(
        "event_id", "campaign_id", "channel", "user_id_hashed", "event_type")


def inventory_turnover(inventory: DataFrame, parts: DataFrame) -> DataFrame:
    j = inventory.join(parts.select("part_id", "category", "unit_cost_eur"), "part_id")
    unit = fx.cents("unit_cost_eur")
    g = j.groupBy("category").agg(
        F.sum(F.col("quantity_on_hand") * unit).alias("cogs_cents"),
        F.sum(F.col("reorder_point") * unit).alias("inventory_cents"))
    return g.withColumn("turnover", fx.inventory_turnover("cogs_cents", "inventory_cents"))


def dispatch_sla_met(dispatch: DataFrame) -> DataFrame:
    return dispatch.select("dispatch_id", fx.dispatch_sla_met("dispatch_time_hours", "sla_target_hours")
                           .alias("sla_met"))


def convert_currency(invoices: DataFrame, rates: DataFrame) -> DataFrame:
    """Every invoice in USD at the rates in force (NULL without a rate)."""
    j = with_usd_rates(invoices, rates)
    rate = (F.when(F.col("currency") == "USD", F.lit(1.0))
            .when(F.col("currency") == "EUR", F.col("usd_rate"))
            .otherwise(F.col("usd_rate") / F.col("own_rate")))
    return j.select("invoice_id", "currency", F.col("amount").cast("double").alias("amount"),
                    rate.alias("rate"), fx.to_usd("amount", "currency", "own_rate", "usd_rate").alias("amount_usd"))


def monthly_revenue_variance(invoices: DataFrame) -> DataFrame:
    """Month-over-month variance of PAID revenue per currency."""
    m = (invoices.filter(F.col("status") == "PAID")
         .withColumn("month", trunc_date("month", "issue_date"))
         .groupBy("currency", "month").agg(F.sum("amount").cast("double").alias("revenue")))
    # One row per (currency, month): a small post-aggregation window.
    w = Window.partitionBy("currency").orderBy("month")
    m = m.withColumn("prev_revenue", F.lag("revenue").over(w))
    return m.filter(F.col("prev_revenue").isNotNull()).withColumn(
        "variance", fx.pct_variance("prev_revenue", "revenue"))
