"""DuckDB oracle texts for the domain views (B*) and formulas (C*).

Written independently of the DataFrame code: plain joins, windows and
aggregates in DuckDB SQL over the shared adapter texts.
"""

from __future__ import annotations

from ..sources.adapters import with_adapters


def ratio(num: str, den: str, scale: int = 2, factor: int = 1) -> str:
    """HALF_UP round(num*factor/den, scale) in exact integer arithmetic."""
    u = 10 ** scale
    return (f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE (CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END)"
            f" * (cast((abs(cast({num} AS hugeint)) * {2 * factor * u} + ({den}))"
            f" // (2 * cast({den} AS hugeint)) AS double) / {u}) END)")


def avg_exact(col: str, scale: int = 4) -> str:
    """Average of values at 8 decimals, rounded once."""
    units = f"cast(sum(cast({col} AS decimal(26,8))) * 100000000 AS hugeint)"
    return f"(CASE WHEN count({col}) > 0 THEN {ratio(units, f'(count({col}) * {10 ** (8 - scale)})', 0)} / {10 ** scale} END)"


def cents(col: str) -> str:
    return f"cast(cast({col} AS decimal(18,2)) * 100 AS bigint)"


def money_sum(col: str) -> str:
    return f"cast(sum(cast({col} AS decimal(18,2))) AS double)"


def usd_at(own: str, usd_rate: str) -> str:
    """An amount in USD by the EUR rates of its currency and of USD."""
    units = "cast(cast({0} AS decimal(10,4)) * 10000 AS hugeint)"
    num = f"(cast(amount * 100 AS hugeint) * {units.format(usd_rate)})"
    den = f"(CASE WHEN currency = 'EUR' THEN 10000 ELSE {units.format(own)} END)"
    return (f"(CASE WHEN currency = 'USD' THEN cast(cast(amount AS decimal(18,2)) AS double)"
            f" WHEN {usd_rate} IS NOT NULL AND {den} > 0 THEN {ratio(num, den, 0)} / 100 END)")


def usd(amount: str, rate: str) -> str:
    return f"cast(round(cast({amount} AS decimal(18,2)) * cast({rate} AS decimal(10,4)), 2) AS double)"


ORACLE: dict[str, str] = {}

ORACLE["weekly_revenue_variance"] = with_adapters(["invoices", "exchange_rates"], f"""
SELECT i.invoice_id, i.account_id, cast(i.amount AS double) AS amount_original,
       i.currency AS currency_original,
       cast(coalesce(r.rate, 1.0) AS double) AS exchange_rate,
       {usd('i.amount', 'coalesce(r.rate, 1.0)')} AS amount_usd
FROM invoices i
LEFT JOIN exchange_rates r ON i.currency = r.target_currency AND r.base_currency = 'EUR'
WHERE i.status = 'PAID'""")

ORACLE["sales_pipeline_conversion"] = with_adapters(["opportunities"], f"""
SELECT stage, count(opp_id) AS total_opportunities,
       {money_sum('amount_eur')} AS total_pipeline_eur,
       {ratio(f"sum({cents('amount_eur')})", 'count(amount_eur)', 0)} / 100 AS avg_deal_size_eur
FROM opportunities GROUP BY stage""")

ORACLE["charger_telemetry_agg"] = with_adapters(["charger_telemetry"], f"""
SELECT charger_id, firmware_version,
       {avg_exact('voltage')} AS avg_voltage,
       {avg_exact('current_amperes')} AS avg_current,
       max(temperature_celsius) AS max_temperature
FROM charger_telemetry GROUP BY charger_id, firmware_version""")

# Naive product form: the oracle checks the pre-aggregated plan.
ORACLE["campaign_attribution"] = with_adapters(["campaign_events", "user_acquisitions"], f"""
SELECT c.channel, count(DISTINCT c.user_id_hashed) AS unique_conversions,
       cast(sum(a.cac_usd) AS double) AS total_cac_usd,
       {ratio(f"sum({cents('a.cac_usd')})", 'count(a.cac_usd)', 0)} / 100 AS avg_cac_usd
FROM campaign_events c JOIN user_acquisitions a ON c.campaign_id = a.campaign_id
WHERE c.event_type = 'Purchase'
GROUP BY c.channel""")

ORACLE["inventory_turnover_view"] = with_adapters(["inventory", "warehouse_dispatch"], """
SELECT i.part_id, i.warehouse_id, i.quantity_on_hand, i.reorder_point,
       d.dispatch_time_hours, d.sla_target_hours,
       CASE WHEN d.dispatch_time_hours <= d.sla_target_hours THEN 1 ELSE 0 END AS on_time_flag
FROM inventory i LEFT JOIN warehouse_dispatch d ON i.part_id = d.order_id""")

_WEEKLY_FX = f"""
r AS (SELECT target_currency, rate_date, max(rate) AS rate FROM exchange_rate_history
      WHERE base_currency = 'EUR' GROUP BY target_currency, rate_date),
firsts AS (SELECT target_currency, arg_min(rate, rate_date) AS first_rate FROM r GROUP BY target_currency),
paid AS (SELECT * FROM invoices WHERE status = 'PAID'),
u AS (SELECT * FROM r WHERE target_currency = 'USD'),
j0 AS (SELECT p.*, r.rate AS own_rate, CASE WHEN r.rate IS NOT NULL THEN f.first_rate END AS own_first
      FROM paid p ASOF LEFT JOIN r ON p.currency = r.target_currency AND p.issue_date >= r.rate_date
      LEFT JOIN firsts f ON p.currency = f.target_currency),
j1 AS (SELECT j0.*, u.rate AS usd_rate, CASE WHEN u.rate IS NOT NULL THEN
              (SELECT first_rate FROM firsts WHERE target_currency = 'USD') END AS usd_first
       FROM j0 ASOF LEFT JOIN u ON j0.issue_date >= u.rate_date),
j AS (SELECT *, {usd_at('own_rate', 'usd_rate')} AS usd FROM j1),
wk AS (SELECT cast(date_trunc('week', issue_date) AS date) AS week_start, currency,
              count(*) AS invoice_count,
              count(*) FILTER (WHERE usd IS NULL) AS without_rate,
              {money_sum('amount')} AS amount_original,
              {money_sum('usd')} AS amount_usd,
              {money_sum("CASE WHEN usd IS NOT NULL THEN " + usd_at('own_first', 'usd_first') + " END")} AS amount_usd_fixed_rate
       FROM j GROUP BY 1, 2),
wkv AS (SELECT *, CASE WHEN amount_usd_fixed_rate = 0 THEN 0.0
                  ELSE abs(amount_usd - amount_usd_fixed_rate) / amount_usd_fixed_rate END AS variance FROM wk)"""


def _with_more(adapters: list[str], extra_ctes: str, body: str) -> str:
    base = with_adapters(adapters, "SELECT 1")
    head = base[: base.rindex("\nSELECT 1")]
    return head + ",\n" + extra_ctes.strip() + "\n" + body


ORACLE["weekly_fx_variance"] = _with_more(["invoices", "exchange_rate_history"], _WEEKLY_FX, "SELECT * FROM wkv")

ORACLE["reconciliation_status"] = _with_more(["invoices", "exchange_rate_history"], _WEEKLY_FX, """
SELECT currency, count(*) AS weeks,
       count(*) FILTER (WHERE abs(variance) <= 0.05) AS reconciled_weeks,
       count(*) FILTER (WHERE abs(variance) > 0.05) AS flagged_weeks,
       cast(sum(CASE WHEN abs(variance) > 0.05 THEN cast(amount_usd AS decimal(18,2)) ELSE 0 END) AS double)
         AS unreconciled_usd
FROM wkv GROUP BY currency""")

ORACLE["monthly_pipeline_by_stage"] = with_adapters(["opportunities"], f"""
SELECT cast(date_trunc('month', close_date) AS date) AS month, stage,
       count(opp_id) AS opportunities, {money_sum('amount_eur')} AS pipeline_eur
FROM opportunities GROUP BY 1, 2""")

ORACLE["hourly_error_telemetry"] = with_adapters(["error_logs", "charger_telemetry"], f"""
, e AS (SELECT date_trunc('hour', log_timestamp) AS hour, count(*) AS error_count,
              count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
              count(*) FILTER (WHERE severity = 'WARNING') AS warning_count,
              count(*) FILTER (WHERE severity = 'INFO') AS info_count
       FROM error_logs GROUP BY 1),
t AS (SELECT date_trunc('hour', event_timestamp) AS hour, count(*) AS readings,
             {avg_exact('temperature_celsius')} AS avg_temperature,
             max(temperature_celsius) AS max_temperature
      FROM charger_telemetry GROUP BY 1)
SELECT coalesce(e.hour, t.hour) AS hour,
       coalesce(e.error_count, 0) AS error_count, coalesce(e.critical_count, 0) AS critical_count,
       coalesce(e.warning_count, 0) AS warning_count, coalesce(e.info_count, 0) AS info_count,
       coalesce(t.readings, 0) AS readings, t.avg_temperature, t.max_temperature
FROM e FULL OUTER JOIN t ON e.hour = t.hour""").replace("\n\n, e AS", ",\ne AS").replace("\n, e AS", ",\ne AS")

ORACLE["reorder_alert"] = with_adapters(["inventory"], """
SELECT part_id, warehouse_id, quantity_on_hand, reorder_point,
       CASE WHEN quantity_on_hand <= reorder_point THEN 'REORDER' ELSE 'OPTIMAL' END AS stock_status
FROM inventory""")

ORACLE["dispatch_sla_adherence"] = with_adapters(["warehouse_dispatch"], f"""
SELECT warehouse_id, count(*) AS dispatches,
       count(*) FILTER (WHERE dispatch_time_hours <= sla_target_hours) AS on_time,
       {ratio('count(*) FILTER (WHERE dispatch_time_hours <= sla_target_hours)', 'count(*)', 2, 100)}
         AS dispatch_sla_adherence_pct
FROM warehouse_dispatch GROUP BY warehouse_id""")

ORACLE["revenue_summary"] = with_adapters(["invoices"], f"""
SELECT issue_date, currency, {money_sum('amount')} AS revenue, count(*) AS invoice_count
FROM invoices WHERE status = 'PAID' GROUP BY issue_date, currency""")

ORACLE["charger_health"] = with_adapters(["charger_telemetry", "error_logs"], f"""
SELECT t.charger_id, t.total_events, coalesce(e.n, 0) AS error_count,
       {ratio('coalesce(e.n, 0)', 't.total_events', 4)} AS error_frequency,
       t.max_temperature, t.max_temperature < 85.0 AS is_safe
FROM (SELECT charger_id, count(*) AS total_events, max(temperature_celsius) AS max_temperature
      FROM charger_telemetry GROUP BY charger_id) t
LEFT JOIN (SELECT charger_id, count(*) AS n FROM error_logs GROUP BY charger_id) e
  ON t.charger_id = e.charger_id""")

ORACLE["telemetry_ingestion_delay"] = with_adapters(["charger_telemetry"], f"""
SELECT charger_id, count(*) AS gaps,
       {ratio('sum(gap_us)', 'count(*)', 0)} / 1000 AS avg_delay_ms,
       cast(max(gap_us) AS double) / 1000 AS max_delay_ms
FROM (SELECT charger_id,
             epoch_us(event_timestamp) - lag(epoch_us(event_timestamp))
               OVER (PARTITION BY charger_id ORDER BY event_timestamp, reading_id) AS gap_us
      FROM charger_telemetry) g
WHERE gap_us IS NOT NULL
GROUP BY charger_id""")

ORACLE["channel_cac"] = with_adapters(["ad_spend", "user_acquisitions", "campaign_events"], f"""
, s AS (SELECT channel, sum({cents('amount_usd')}) AS spend_cents FROM ad_spend GROUP BY channel),
cc AS (SELECT DISTINCT campaign_id, channel FROM campaign_events),
a AS (SELECT cc.channel, count(*) AS acquisitions FROM user_acquisitions u JOIN cc ON u.campaign_id = cc.campaign_id
      GROUP BY cc.channel)
SELECT coalesce(s.channel, a.channel) AS channel, cast(coalesce(s.spend_cents, 0) AS double) / 100 AS spend_usd,
       coalesce(a.acquisitions, 0) AS acquisitions,
       {ratio('coalesce(s.spend_cents, 0)', 'coalesce(a.acquisitions, 0)', 0)} / 100 AS cac_usd
FROM s FULL OUTER JOIN a ON s.channel = a.channel""").replace("\n, s AS", ",\ns AS")

ORACLE["weighted_pipeline"] = with_adapters(["opportunities"], f"""
, w AS (SELECT * FROM (VALUES ('Prospecting', 0.1), ('Qualified', 0.3), ('Negotiation', 0.6),
                              ('Won', 1.0), ('Lost', 0.0)) AS t(stage, weight))
SELECT o.stage, cast(max(w.weight) AS double) AS weight, {money_sum('o.amount_eur')} AS pipeline_eur,
       cast(sum(o.amount_eur * coalesce(cast(w.weight AS decimal(3,1)), 0)) AS double) AS weighted_eur
FROM opportunities o LEFT JOIN w ON o.stage = w.stage GROUP BY o.stage""").replace("\n, w AS", ",\nw AS")

ORACLE["funnel_conversion"] = with_adapters(["campaign_events"], f"""
, n AS (SELECT step_no, step, (SELECT count(DISTINCT user_id) FROM campaign_events c WHERE c.event_type = s.step) AS users
       FROM (VALUES (1, 'Impression'), (2, 'Click'), (3, 'Signup'), (4, 'Purchase')) AS s(step_no, step))
SELECT a.step_no, a.step, a.users, {ratio('a.users', 'coalesce(b.users, a.users)', 2, 100)} AS step_rate_pct
FROM n a LEFT JOIN n b ON b.step_no = a.step_no - 1""").replace("\n, n AS", ",\nn AS")

ORACLE["cohort_retention"] = with_adapters(["campaign_events"], """
, wk AS (SELECT DISTINCT user_id, cast(date_trunc('week', event_timestamp) AS date) AS week FROM campaign_events),
f AS (SELECT user_id, min(week) AS cohort_week FROM wk GROUP BY user_id)
SELECT f.cohort_week, cast((wk.week - f.cohort_week) / 7 AS int) AS weeks_since, count(*) AS active_users
FROM wk JOIN f ON wk.user_id = f.user_id GROUP BY 1, 2""").replace("\n, wk AS", ",\nwk AS")

ORACLE["energy_billing"] = with_adapters(["billing_events"], f"""
SELECT account_id, charger_id, cast(event_timestamp AS date) AS day, count(*) AS sessions,
       cast(round(sum(cast(kwh_consumed AS decimal(26,8))), 2) AS double) AS kwh
FROM billing_events GROUP BY 1, 2, 3""")

ORACLE["multi_touch_attribution"] = with_adapters(["campaign_events"], f"""
, t AS (SELECT user_id, channel, event_id AS touch_id, event_timestamp AS ts FROM campaign_events
       WHERE event_type IN ('Click', 'Impression')),
p AS (SELECT user_id, event_id AS purchase_id, event_timestamp AS ts FROM campaign_events WHERE event_type = 'Purchase'),
pairs AS (SELECT p.purchase_id, t.channel, t.touch_id, t.ts,
                 count(*) OVER (PARTITION BY p.purchase_id) AS n,
                 row_number() OVER (PARTITION BY p.purchase_id ORDER BY t.ts, t.touch_id) AS rk
          FROM p JOIN t ON t.user_id = p.user_id AND t.ts > p.ts - INTERVAL 30 DAY AND t.ts <= p.ts),
tot AS (SELECT count(DISTINCT purchase_id) AS purchases FROM pairs),
c AS (SELECT channel, count(*) AS window_touches, sum(1.0 / n) AS credit,
             count(*) FILTER (WHERE rk = 1) AS first_touch_purchases FROM pairs GROUP BY channel)
SELECT channel, window_touches, round(credit, 6) AS touch_credit,
       round(credit * 100 / (SELECT purchases FROM tot), 4) AS credit_share_pct,
       first_touch_purchases,
       {ratio('first_touch_purchases', '(SELECT purchases FROM tot)', 2, 100)} AS first_touch_pct
FROM c""")

ORACLE["attributed_cac"] = with_adapters(["campaign_events", "campaign_spend"], f"""
, t AS (SELECT user_id, channel, event_timestamp AS ts FROM campaign_events WHERE event_type IN ('Click', 'Impression')),
p AS (SELECT user_id, event_id AS purchase_id, event_timestamp AS ts FROM campaign_events WHERE event_type = 'Purchase'),
pairs AS (SELECT p.purchase_id, cast(p.ts AS date) AS day, t.channel, count(*) OVER (PARTITION BY p.purchase_id) AS n
          FROM p JOIN t ON t.user_id = p.user_id AND t.ts > p.ts - INTERVAL 30 DAY AND t.ts <= p.ts),
g AS (SELECT channel, day, n, count(*) AS touches FROM pairs GROUP BY 1, 2, 3),
cr AS (SELECT channel, day, sum(cast(touches AS hugeint) * 1000000000000 // n) AS units FROM g GROUP BY 1, 2),
sp AS (SELECT channel, spend_date AS day, sum({cents('amount_usd')}) AS cents FROM campaign_spend GROUP BY 1, 2),
d AS (SELECT coalesce(cr.channel, sp.channel) AS channel, cr.units, sp.cents FROM cr FULL JOIN sp ON cr.channel = sp.channel AND cr.day = sp.day),
c AS (SELECT channel, coalesce(sum(cents), 0) AS cents, coalesce(sum(cents) FILTER (units > 0), 0) AS credited,
             coalesce(sum(units), 0) AS units, count(*) FILTER (units > 0) AS credit_days FROM d GROUP BY 1)
SELECT channel, credit_days, {ratio('units', '1000000000000', 6)} AS credited_purchases, cast(cents AS double) / 100 AS spend_usd,
       cast(cents - credited AS double) / 100 AS idle_usd, {ratio('cents', 'units', 0, 10 ** 12)} / 100 AS cac_usd,
       {ratio('credited', 'units', 0, 10 ** 12)} / 100 AS credited_cac_usd
FROM c""")
