"""Domain views: seed golden rows and equivalence with brute force."""
from collections import defaultdict
from datetime import timedelta

from pyspark.sql import functions as F

from ledgerline.operators import formula_queries as C
from ledgerline.operators import views as V
from ledgerline.sources import sinks


def test_weekly_revenue_variance_on_seed(spark):
    out = V.weekly_revenue_variance(sinks.seed_invoices(spark), sinks.seed_rates(spark))
    got = sorted((r.invoice_id, r.exchange_rate, r.amount_usd) for r in out.collect())
    assert got == [("INV-2026-001", 1.0, 1250.0), ("INV-2026-002", 1.085, 9114.54),
                   ("INV-2026-002", 1.0865, 9127.14), ("INV-2026-003", 0.853, 2644.3),
                   ("INV-2026-003", 0.854, 2647.4)]
    assert "computed_at" in V.weekly_revenue_variance(sinks.seed_invoices(spark), sinks.seed_rates(spark),
                                                      with_ts=True).columns


def test_campaign_attribution_equals_naive_join(small):
    ev, acq = small.campaign_events, small.user_acquisitions
    naive = (ev.filter(F.col("event_type") == "Purchase").join(acq, "campaign_id")
             .groupBy("channel").agg(F.countDistinct("user_id_hashed").alias("u"),
                                     F.sum("cac_usd").cast("double").alias("t")))
    exp = {r.channel: (r.u, r.t) for r in naive.collect()}
    got = {r.channel: (r.unique_conversions, r.total_cac_usd) for r in V.campaign_attribution(ev, acq).collect()}
    assert got == exp


def test_rates_in_force_equal_brute_force(small):
    inv, rates = small.invoices, small.exchange_rate_history
    rr = [(r.target_currency, r.rate_date, r.rate) for r in rates.collect()]

    def rate(currency, day):
        known = [(d, x) for c, d, x in rr if c == currency and d <= day]
        return max(known)[1] if known else None

    got = {r.invoice_id: (r.own_rate, r.usd_rate) for r in V.with_usd_rates(inv, rates).collect()}
    for r in inv.collect():
        assert got[r.invoice_id] == (rate(r.currency, r.issue_date), rate("USD", r.issue_date))


def test_usd_amounts_by_hand(spark):
    inv = spark.sql("""SELECT * FROM VALUES
      ('e', 'EUR', 100.00, DATE'2024-01-10'), ('u', 'USD', 100.00, DATE'2024-01-10'),
      ('g', 'GBP', 100.00, DATE'2024-01-10'), ('r', 'EUR', -12.50, DATE'2024-02-10'),
      ('x', 'CHF', 100.00, DATE'2024-01-10'), ('o', 'EUR', 100.00, DATE'2023-12-31')
      AS t(invoice_id, currency, amount, issue_date)""").selectExpr(
        "invoice_id", "currency", "cast(amount as decimal(18,2)) amount", "issue_date", "'PAID' status")
    rates = spark.sql("""SELECT * FROM VALUES
      (DATE'2024-01-01', 'EUR', 'USD', 1.0850D), (DATE'2024-02-01', 'EUR', 'USD', 1.1000D),
      (DATE'2024-01-01', 'EUR', 'GBP', 0.8540D) AS t(rate_date, base_currency, target_currency, rate)""")
    got = {r.invoice_id: r.amount_usd for r in C.convert_currency(inv, rates).collect()}
    # 100 EUR = 108.50; 100 GBP = 100 / 0.854 * 1.085 = 127.05; no rate: NULL
    assert got == {"e": 108.5, "u": 100.0, "g": 127.05, "r": -13.75, "x": None, "o": None}
    weekly = V.weekly_fx_variance(inv, rates).collect()
    assert sum(r.without_rate for r in weekly) == 2
    row = next(r for r in weekly if r.currency == "EUR" and r.amount_usd == -13.75)
    assert row.amount_usd_fixed_rate == -13.56  # -12.5 * 1.085 = -13.5625


def test_no_rounding_before_an_aggregate(spark):
    rows = spark.range(1000).selectExpr("1 account_id", "2 charger_id", "0.004D kwh_consumed",
                                        "timestamp_ntz'2024-01-01 00:00:00' event_timestamp")
    assert V.energy_billing(rows).first().kwh == 4.0
    readings = spark.range(1000).selectExpr("1 charger_id", "'f' firmware_version", "230.000049D voltage",
                                            "10.000004D current_amperes", "20.0D temperature_celsius")
    row = V.charger_telemetry_agg(readings).first()
    assert (row.avg_voltage, row.avg_current) == (230.0, 10.0)
    mixed = spark.sql("SELECT 1 charger_id, 'f' firmware_version, v voltage, v current_amperes, v temperature_celsius"
                      " FROM VALUES (0.00004D), (0.00004D), (0.00008D) AS t(v)")
    assert V.charger_telemetry_agg(mixed).first().avg_voltage == 0.0001  # 0.0000533 rounds up; 4 dp inputs give 0.0


def test_average_of_refunds_rounds_half_away_from_zero(spark):
    opps = spark.sql("SELECT 1 opp_id, 'Won' stage, cast(-0.12 as decimal(18,2)) amount_eur UNION ALL"
                     " SELECT 2, 'Won', cast(-0.13 as decimal(18,2))")
    assert V.sales_pipeline_conversion(opps).first().avg_deal_size_eur == -0.13


def test_channel_without_spend_is_kept(spark):
    spend = spark.sql("SELECT 'Search' channel, cast(10 as decimal(18,2)) amount_usd")
    acq = spark.sql("SELECT 1 campaign_id")
    events = spark.sql("SELECT 1 campaign_id, 'Social' channel")
    got = {r.channel: (r.spend_usd, r.acquisitions, r.cac_usd) for r in V.channel_cac(spend, acq, events).collect()}
    assert got == {"Search": (10.0, 0, 0.0), "Social": (0.0, 1, 0.0)}


def test_multi_touch_attribution_equals_brute_force(small):
    ev = small.campaign_events.select("event_id", "user_id", "channel", "event_type", "event_timestamp").collect()
    touches = defaultdict(list)
    for e in ev:
        if e.event_type in ("Click", "Impression"):
            touches[e.user_id].append(e)
    credit, first, window = defaultdict(float), defaultdict(int), defaultdict(int)
    purchases = 0
    for p in ev:
        if p.event_type != "Purchase":
            continue
        lo = p.event_timestamp - timedelta(days=30)
        inside = sorted((t for t in touches[p.user_id] if lo < t.event_timestamp <= p.event_timestamp),
                        key=lambda t: (t.event_timestamp, t.event_id))
        if not inside:
            continue
        purchases += 1
        first[inside[0].channel] += 1
        for t in inside:
            credit[t.channel] += 1 / len(inside)
            window[t.channel] += 1
    got = {r.channel: r for r in V.multi_touch_attribution(small.campaign_events).collect()}
    assert set(got) == set(window)
    for ch, r in got.items():
        assert r.window_touches == window[ch]
        assert abs(r.touch_credit - credit[ch]) < 1e-6
        assert r.first_touch_purchases == first[ch]
        assert abs(r.first_touch_pct - round(100 * first[ch] / purchases, 2)) < 0.0051


def test_credits_add_up_to_the_purchases(small):
    """As fractions, the credits of all channels are the purchases exactly."""
    from fractions import Fraction

    shares = V.touch_shares(small.campaign_events)
    purchases = shares.select("purchase_id").distinct().count()
    rows = V.daily_credits(shares).collect()
    assert sum(Fraction(r.touches, r.n) for r in rows) == purchases > 0
    per_n = defaultdict(int)
    for r in rows:
        per_n[r.n] += r.touches
    assert all(touches % n == 0 for n, touches in per_n.items())


def test_attributed_cac_by_hand(spark):
    from datetime import date, datetime
    from decimal import Decimal

    def ev(i, user, channel, kind, day):
        return (i, user, channel, kind, datetime(2024, 1, day, 12))

    events = spark.createDataFrame(
        [ev(1, 1, "A", "Click", 1), ev(2, 1, "A", "Impression", 2), ev(3, 1, "B", "Click", 2), ev(4, 1, "C", "Purchase", 3),
         ev(5, 2, "B", "Click", 4), ev(6, 2, "B", "Purchase", 5), ev(7, 3, "A", "Purchase", 6)],
        "event_id long, user_id long, channel string, event_type string, event_timestamp timestamp_ntz")
    spend = spark.createDataFrame(
        [("A", Decimal("10.00"), date(2024, 1, 3)), ("A", Decimal("5.00"), date(2024, 1, 4)), ("B", Decimal("4.00"), date(2024, 1, 3)),
         ("B", Decimal("6.00"), date(2024, 1, 5)), ("D", Decimal("1.00"), date(2024, 1, 5))],
        "channel string, amount_usd decimal(18,2), spend_date date")
    got = {r.channel: tuple(r)[1:] for r in V.attributed_cac(events, spend).collect()}
    assert got == {"A": (1, 0.666667, 15.0, 5.0, 22.5, 15.0), "B": (2, 1.333333, 10.0, 0.0, 7.5, 7.5), "D": (0, 0.0, 1.0, 1.0, 0.0, 0.0)}
