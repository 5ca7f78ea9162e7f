"""Classification and access rules (H*)."""
from ledgerline.operators import access as H


def test_delivery_path(spark):
    briefs = spark.createDataFrame([
        (1, "Create a weekly currency variance report dashboard for finance"),
        (2, "Build a Python API endpoint with a webhook"),
        (3, "Rapid aggregate view"),  # 'api' inside 'Rapid' -> multi-agent
    ], "brief_id long, brief_text string")
    got = {r.brief_id: r.recommended_path for r in H.delivery_path(briefs).collect()}
    assert got == {1: "direct_connector_automation", 2: "multi_agent_software_dev", 3: "multi_agent_software_dev"}


def test_domain_route(spark):
    briefs = spark.createDataFrame([
        (1, "campaign CAC by channel", None), (2, "charger telemetry", None), (3, "warehouse stock", None),
        (4, "CRM pipeline", None), (5, "nothing known", None), (6, "charger telemetry", "Sales"),
        (7, "ship marketing", ""),
    ], "brief_id long, brief_text string, requested_domain string")
    got = {r.brief_id: r.domain for r in H.domain_routes(briefs).collect()}
    assert got == {1: "marketing", 2: "firmware", 3: "logistics", 4: "sales", 5: "finance", 6: "sales",
                   7: "marketing"}


def test_access_decisions(spark):
    actors = spark.createDataFrame([
        (1, "human", ["sales_lead"], "finance"),      # denied
        (2, "human", ["finance_admin"], "firmware"),  # superuser
        (3, "agent", ["nothing"], "finance"),         # agents pass
        (4, "human", [], "logistics"),                # default roles -> allowed
        (5, "human", ["finance_analyst"], "unknown"),  # unknown domain -> finance roles
    ], "request_id long, actor_type string, roles array<string>, node_id string")
    got = {r.request_id: r.allowed for r in H.access_decisions(actors).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True}
    grants = {r.request_id: r.granted_roles for r in H.default_role_grants(actors).collect()}
    assert grants == {4: "supply_chain_lead,plant_manager,finance_admin"}


def test_normalize_identity(spark):
    actors = spark.createDataFrame([
        (1, "human", "accounts.example:ana@example.com", True, None, ["x"], "finance"),
        (2, "human", "accounts.example:bo@example.com", False, "Ops", ["x"], "sales"),
        (3, "human", None, False, None, [], "firmware"),
    ], "request_id long, actor_type string, raw_email string, via_proxy boolean, department string, "
       "roles array<string>, node_id string")
    got = {r.request_id: (r.user_email, r.subject_id, r.department) for r in H.normalize_identity(actors).collect()}
    assert got[1] == ("ana@example.com", "iap|ana@example.com", "Finance")
    assert got[2] == ("bo@example.com", "google|accounts.example:bo@example.com", "Ops")
    assert got[3] == ("user@example.com", "google|user@example.com", "Firmware")
