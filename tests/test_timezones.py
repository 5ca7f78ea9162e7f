"""Results do not depend on spark.sql.session.timeZone (zone-less inputs)."""
import pytest

from __spark_entry__ import queries
from paths import SF_SMALL

TIME_QUERIES = ["hourly_error_telemetry", "telemetry_ingestion_delay", "multi_touch_attribution",
                "weekly_fx_variance", "cohort_retention", "stage_durations", "pending_gates", "recent_artifacts",
                "health_30d"]


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York"])
def test_time_queries_are_zone_free(spark, zone):
    q = queries()
    base = {n: sorted(map(tuple, q[n](spark, SF_SMALL).collect())) for n in TIME_QUERIES}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for n in TIME_QUERIES:
            assert sorted(map(tuple, q[n](spark, SF_SMALL).collect())) == base[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
