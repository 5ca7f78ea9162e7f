"""DuckDB oracle texts for the formula queries."""

from __future__ import annotations

from ..sources.adapters import with_adapters
from .oracle_views import cents, ratio, usd_at

ORACLE: dict[str, str] = {}

ORACLE["stage_conversion_rate"] = with_adapters(["opportunities"], f"""
SELECT cast(date_trunc('month', close_date) AS date) AS month,
       count(*) FILTER (WHERE stage = 'Won') AS won, count(*) AS total,
       {ratio("count(*) FILTER (WHERE stage = 'Won')", 'count(*)', 2, 100)} AS conversion_rate_pct
FROM opportunities GROUP BY 1""")

ORACLE["mask_pii"] = with_adapters(["opportunities"], """
SELECT opp_id,
       CASE WHEN account_name IS NULL OR length(account_name) <= 2 THEN '***'
            ELSE left(account_name, 1) || repeat('*', length(account_name) - 2) || right(account_name, 1)
       END AS account_name_masked
FROM opportunities""")

ORACLE["parse_telemetry"] = with_adapters(["charger_telemetry"], """
SELECT reading_id, cast(voltage AS double) AS voltage, cast(current_amperes AS double) AS current_amperes,
       cast(round(cast(voltage AS decimal(19,8)) * cast(current_amperes AS decimal(19,8)), 0) AS double) / 1000
         AS power_kw
FROM charger_telemetry""")

ORACLE["safe_temperature"] = with_adapters(["charger_telemetry"], """
SELECT reading_id, temperature_celsius, temperature_celsius < 85.0 AS is_safe FROM charger_telemetry""")

ORACLE["cac_monthly"] = with_adapters(["ad_spend", "user_acquisitions", "campaign_events"], f"""
, s AS (SELECT channel, cast(date_trunc('month', spend_date) AS date) AS month,
              sum({cents('amount_usd')}) AS spend_cents FROM ad_spend GROUP BY 1, 2),
cc AS (SELECT DISTINCT campaign_id, channel FROM campaign_events),
a AS (SELECT cc.channel, cast(date_trunc('month', converted_at) AS date) AS month, count(*) AS acquisitions
      FROM user_acquisitions u JOIN cc ON u.campaign_id = cc.campaign_id GROUP BY 1, 2),
j AS (SELECT coalesce(s.channel, a.channel) AS channel, coalesce(s.month, a.month) AS month,
             coalesce(s.spend_cents, 0) AS spend_cents, coalesce(a.acquisitions, 0) AS acquisitions
      FROM s FULL OUTER JOIN a ON s.channel = a.channel AND s.month = a.month)
SELECT channel, month, spend_cents, acquisitions,
       {ratio('spend_cents', 'acquisitions', 0)} / 100 AS cac_usd
FROM j""")

ORACLE["consent_filter"] = with_adapters(["campaign_events"], """
SELECT event_id, campaign_id, channel, user_id_hashed, event_type
FROM campaign_events WHERE coalesce(consent_granted, false)""")

ORACLE["inventory_turnover"] = with_adapters(["inventory", "parts_catalog"], f"""
, g AS (SELECT p.category,
              sum(i.quantity_on_hand * {cents('p.unit_cost_eur')}) AS cogs_cents,
              sum(i.reorder_point * {cents('p.unit_cost_eur')}) AS inventory_cents
       FROM inventory i JOIN parts_catalog p ON i.part_id = p.part_id GROUP BY p.category)
SELECT category, cogs_cents, inventory_cents, {ratio('cogs_cents', 'inventory_cents', 2)} AS turnover FROM g""")

ORACLE["dispatch_sla_met"] = with_adapters(["warehouse_dispatch"], """
SELECT dispatch_id, dispatch_time_hours <= sla_target_hours AS sla_met FROM warehouse_dispatch""")

ORACLE["convert_currency"] = with_adapters(["invoices", "exchange_rate_history"], f"""
, r AS (SELECT target_currency, rate_date, max(rate) AS rate FROM exchange_rate_history
       WHERE base_currency = 'EUR' GROUP BY 1, 2)
, u AS (SELECT * FROM r WHERE target_currency = 'USD'),
j0 AS (SELECT i.*, r.rate AS own_rate
       FROM invoices i ASOF LEFT JOIN r ON i.currency = r.target_currency AND i.issue_date >= r.rate_date),
j AS (SELECT j0.*, u.rate AS usd_rate FROM j0 ASOF LEFT JOIN u ON j0.issue_date >= u.rate_date)
SELECT invoice_id, currency, cast(amount AS double) AS amount,
       CASE WHEN currency = 'USD' THEN 1.0::DOUBLE WHEN currency = 'EUR' THEN usd_rate
            ELSE usd_rate / own_rate END AS rate,
       {usd_at('own_rate', 'usd_rate')} AS amount_usd
FROM j""").replace("\n, u AS", ",\nu AS")

ORACLE["pct_variance"] = with_adapters(["invoices"], """
, m AS (SELECT currency, cast(date_trunc('month', issue_date) AS date) AS month,
              cast(sum(amount) AS double) AS revenue
       FROM invoices WHERE status = 'PAID' GROUP BY 1, 2),
l AS (SELECT *, lag(revenue) OVER (PARTITION BY currency ORDER BY month) AS prev_revenue FROM m)
SELECT currency, month, revenue, prev_revenue,
       CASE WHEN prev_revenue = 0 THEN 0.0 ELSE abs(revenue - prev_revenue) / prev_revenue END AS variance
FROM l WHERE prev_revenue IS NOT NULL""")
