"""Plan guards for every registered batch query: no Python UDF operators,
no nested-loop or cartesian joins, and every plan reads the driver files."""
import pytest

from __spark_entry__ import queries
from paths import SF_SMALL
from ledgerline.plans.registry import PLANS

BATCH = sorted(n for n in PLANS if not n.startswith(("stream_", "sink_")))


@pytest.mark.parametrize("name", BATCH)
def test_plan_shape(spark, name):
    df = queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, f"{name}: {bad}"
    assert "FileScan parquet" in plan or "Scan parquet" in plan, f"{name}: reads no driver table"
