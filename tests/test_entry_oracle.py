"""The driver contract: entry() and every registered query against its
DuckDB oracle on the smallest scale factor (same comparison as the driver)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from oracle_check import digest, duck  # noqa: E402
from paths import SF_SMALL  # noqa: E402
from ledgerline.plans.registry import PLANS  # noqa: E402


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["invoice_id", "account_id"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql()[name]  # every query of the registry has its SQL
    cur = con.execute(sql)
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
