"""Brief classification, identity and access decisions (H1-H7).

Keyword rules are plain substring tests on the lower-cased text (they match
inside words, as the rules are defined); role rules are array expressions
against constant per-domain maps.  All narrow, no joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import SUPERUSER_ROLES, known_domain, rule_lookup

# ---------------------------------------------------------------------------
# Keyword lists of the path and domain rules.
# ---------------------------------------------------------------------------
DIRECT_KEYWORDS = ["report", "view", "query", "dashboard", "aggregate", "variance view",
                   "select", "pull data", "extract", "salesforce", "netsuite", "notion"]
AGENT_KEYWORDS = ["custom script", "api", "webhook", "microservice", "python",
                  "algorithm", "library", "sdk", "complex workflow", "endpoint"]
DIRECT_PATH = "direct_connector_automation"
AGENT_PATH = "multi_agent_software_dev"
# Domain routing: first matching group wins, default finance.
DOMAIN_KEYWORDS = [
    ("marketing", ["market", "campaign", "cac"]),
    ("firmware", ["firmware", "iot", "charger", "telemetry"]),
    ("logistics", ["logistics", "ship", "warehouse", "inventory"]),
    ("sales", ["sale", "crm", "pipeline"]),
    ("finance", ["finance", "invoice", "currency", "revenue", "variance"]),
]
AGENT_EMAIL_PREFIX = "sa-agent-"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hits(low: Column, words: list[str]) -> Column:
    """Number of distinct keywords contained (unrolled, code-generated)."""
    total = None
    for w in words:
        one = F.when(low.contains(w), 1).otherwise(0)
        total = one if total is None else total + one
    return total


# H1
def delivery_path(briefs: DataFrame, text: str = "brief_text") -> DataFrame:
    # Lower-case once per row (a separate projection Catalyst keeps, as the
    # folded text is referenced by every keyword test).
    b = briefs.withColumn("_lc", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = F.col("_lc")
    d, a = _hits(low, DIRECT_KEYWORDS), _hits(low, AGENT_KEYWORDS)
    direct = (d >= a) & ~low.contains("python") & ~low.contains("api")
    return b.select("brief_id", d.alias("direct_score"), a.alias("agent_score"),
                         F.when(direct, DIRECT_PATH).otherwise(AGENT_PATH).alias("recommended_path"))


# H2
def route_domain(text: Column | str, requested: Column | str | None = None,
                 lower: Column | None = None) -> Column:
    low = F.lower(F.coalesce(_c(text), F.lit(""))) if lower is None else lower
    chain = None
    for domain, words in DOMAIN_KEYWORDS:
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        chain = F.when(cond, domain) if chain is None else chain.when(cond, domain)
    by_text = chain.otherwise("finance")
    if requested is None:
        return by_text
    req = _c(requested)
    return F.when(req.isNotNull() & (req != ""), F.lower(req)).otherwise(by_text)


def _folded(briefs: DataFrame) -> DataFrame:
    return briefs.withColumn("_lc", F.lower(F.coalesce(F.col("brief_text"), F.lit(""))))


def domain_routes(briefs: DataFrame) -> DataFrame:
    return _folded(briefs).select(
        "brief_id", route_domain("brief_text", "requested_domain", F.col("_lc")).alias("domain"))


# H7 / H4
def effective_roles(roles: Column | str, domain: Column | str) -> Column:
    """A request without roles gets the domain's own roles."""
    r = _c(roles)
    return F.when(F.coalesce(F.size(r), F.lit(0)) <= 0, rule_lookup(_c(domain), "roles")).otherwise(r)


def default_role_grants(actors: DataFrame) -> DataFrame:
    empty = F.coalesce(F.size("roles"), F.lit(0)) <= 0
    return actors.filter(empty).select(
        "request_id", "node_id",
        F.array_join(rule_lookup(F.col("node_id"), "roles"), ",").alias("granted_roles"))


def normalize_identity(actors: DataFrame, default_email: str = "user@example.com") -> DataFrame:
    raw = F.coalesce(F.col("raw_email"), F.lit(default_email))
    email = F.element_at(F.split(raw, ":"), -1)
    subject = F.when(F.col("via_proxy"), F.concat(F.lit("iap|"), email)).otherwise(
        F.concat(F.lit("google|"), raw))
    dept = F.coalesce(F.col("department"), F.initcap("node_id"))
    return actors.select("request_id", "actor_type", email.alias("user_email"), subject.alias("subject_id"),
                         dept.alias("department"),
                         F.array_join(effective_roles("roles", "node_id"), ",").alias("roles"))


# H3
def access_allowed(actor_type: Column | str, roles: Column | str, domain: Column | str) -> Column:
    r = _c(roles)
    superuser = F.arrays_overlap(r, F.array(*[F.lit(x) for x in SUPERUSER_ROLES]))
    overlap = F.arrays_overlap(r, rule_lookup(_c(domain), "roles"))
    return (_c(actor_type) == "agent") | F.coalesce(superuser, F.lit(False)) | F.coalesce(overlap, F.lit(False))


def access_decisions(actors: DataFrame) -> DataFrame:
    roles = effective_roles("roles", "node_id")
    return actors.select("request_id", "node_id", known_domain(F.col("node_id")).alias("rules_domain"),
                         access_allowed("actor_type", roles, "node_id").alias("allowed"))


# H5
def actor_split(audit: DataFrame) -> DataFrame:
    kind = F.when(F.col("actor_email").startswith(AGENT_EMAIL_PREFIX), "agent").otherwise("human")
    return audit.groupBy("node_id", kind.alias("actor_kind")).agg(F.count(F.lit(1)).alias("actions"))


# H6
def table_allowlist(briefs: DataFrame) -> DataFrame:
    """Per brief: requested tables outside the routed domain's allowlist
    (count 0 and empty list when all are allowed).  Every brief is kept: a
    filter on the routed domain would be pushed by Catalyst below the
    case-folding projection and re-fold the text once per keyword."""
    routed = _folded(briefs).withColumn("domain", route_domain("brief_text", "requested_domain", F.col("_lc")))
    bad = F.array_except(F.col("requested_tables"), rule_lookup(F.col("domain"), "tables"))
    out = routed.select("brief_id", "domain", bad.alias("bad"))
    return out.select("brief_id", "domain", F.size("bad").alias("denied_tables"),
                      F.array_join("bad", ",").alias("tables"))
