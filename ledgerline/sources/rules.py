"""Domain rule tables (A6): roles, table allowlists, mandatory metrics,
prohibited SQL patterns and acceptance criteria per business domain.

The rules are a handful of constants per domain.  They are used two ways:
as tiny DataFrames (``rule_tables``) and, in the bulk checks, as constant
maps looked up per row (``rule_lookup``) so no join or row explosion is
needed.  An unknown domain falls back to the finance rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import DOMAINS

# ---------------------------------------------------------------------------
# The five domain manifests.
# ---------------------------------------------------------------------------
DOMAIN_RULES = {
    "finance": {
        "roles": ["finance_admin", "financial_controller", "finance_analyst"],
        "tables": ["finance_demo.invoices", "finance_demo.billing_events",
                   "finance_demo.exchange_rates", "finance_demo.revenue_summary"],
        "metrics": ["target_sla_seconds", "baseline_error_rate", "reconciliation_variance_tolerance_pct"],
        "prohibited": ["DROP TABLE", "DELETE FROM", "TRUNCATE", "ALTER TABLE"],
        "min_pass_rate": 100.0, "min_coverage_pct": 90.0, "max_query_cost_usd": 2.50,
        "test_types": ["unit", "sql_syntax_lint", "null_value_boundary", "currency_precision_check"],
    },
    "sales": {
        "roles": ["sales_lead", "commercial_ops", "finance_admin"],
        "tables": ["sales_demo.opportunities", "sales_demo.accounts", "sales_demo.lead_conversions"],
        "metrics": ["target_sla_seconds", "baseline_error_rate", "conversion_variance_pct"],
        "prohibited": ["DROP TABLE", "DELETE FROM", "TRUNCATE"],
        "min_pass_rate": 100.0, "min_coverage_pct": 85.0, "max_query_cost_usd": 1.50,
        "test_types": ["unit", "sql_syntax_lint", "pii_masking_check"],
    },
    "firmware": {
        "roles": ["firmware_engineer", "embedded_lead", "iot_operator"],
        "tables": ["firmware_demo.charger_telemetry", "firmware_demo.firmware_releases",
                   "firmware_demo.error_logs"],
        "metrics": ["target_sla_seconds", "baseline_error_rate", "telemetry_ingestion_delay_ms"],
        "prohibited": ["DROP TABLE", "DELETE FROM", "TRUNCATE"],
        "min_pass_rate": 100.0, "min_coverage_pct": 90.0, "max_query_cost_usd": 3.00,
        "test_types": ["unit", "telemetry_schema_validation", "ocpp_compliance_check"],
    },
    "marketing": {
        "roles": ["marketing_manager", "growth_analyst"],
        "tables": ["marketing_demo.campaign_events", "marketing_demo.user_acquisitions",
                   "marketing_demo.ad_spend"],
        "metrics": ["target_sla_seconds", "baseline_error_rate", "cac_calculation_variance_pct"],
        "prohibited": ["DROP TABLE", "DELETE FROM", "TRUNCATE"],
        "min_pass_rate": 100.0, "min_coverage_pct": 85.0, "max_query_cost_usd": 1.00,
        "test_types": ["unit", "sql_syntax_lint", "gdpr_cookie_consent_filter_check"],
    },
    "logistics": {
        "roles": ["supply_chain_lead", "plant_manager", "finance_admin"],
        "tables": ["logistics_demo.inventory", "logistics_demo.warehouse_dispatch",
                   "logistics_demo.parts_catalog"],
        "metrics": ["target_sla_seconds", "baseline_error_rate", "dispatch_sla_adherence_pct"],
        "prohibited": ["DROP TABLE", "DELETE FROM", "TRUNCATE"],
        "min_pass_rate": 100.0, "min_coverage_pct": 85.0, "max_query_cost_usd": 1.50,
        "test_types": ["unit", "sql_syntax_lint", "dispatch_sla_check"],
    },
}
DEFAULT_DOMAIN = "finance"
SUPERUSER_ROLES = ["admin", "finance_admin"]


def known_domain(domain: Column) -> Column:
    """The domain if it has a manifest, else finance."""
    return F.when(domain.isin(list(DOMAIN_RULES)), domain).otherwise(F.lit(DEFAULT_DOMAIN))


def rule_lookup(domain: Column, field: str) -> Column:
    """Per-row value of a manifest field, as a constant map lookup."""
    entries = []
    for name, rules in DOMAIN_RULES.items():
        value = rules[field]
        lit = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        entries += [F.lit(name), lit]
    return F.element_at(F.create_map(*entries), known_domain(domain))


def rule_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The manifests as five small tables (broadcast when joined)."""
    def rows(field):
        return [(d, i + 1, v) for d in DOMAINS for i, v in enumerate(DOMAIN_RULES[d][field])]

    schema = "domain string, pos int, value string"
    return {
        "roles": spark.createDataFrame(rows("roles"), schema),
        "tables": spark.createDataFrame(rows("tables"), schema),
        "metrics": spark.createDataFrame(rows("metrics"), schema),
        "prohibited_patterns": spark.createDataFrame(rows("prohibited"), schema),
        "acceptance": spark.createDataFrame(
            [(d, DOMAIN_RULES[d]["min_pass_rate"], DOMAIN_RULES[d]["min_coverage_pct"],
              DOMAIN_RULES[d]["max_query_cost_usd"]) for d in DOMAINS],
            "domain string, min_pass_rate double, min_coverage_pct double, max_query_cost_usd double"),
    }
