"""Schema catalog: table sizes from one pass over each driver file."""
from collections import Counter

from pyspark.sql import functions as F

from ledgerline.sources import schemas as S
from ledgerline.sources.tables import Tables


def _true(tables):
    return {tbl: tables.get(tbl).count() for tbls in S.CATALOG.values() for tbl in tbls}


def test_counts_equal_the_tables(small):
    got = {r.table_name: r.num_rows for r in S.row_counts(small).collect()}
    assert got == _true(small) and all(got.values())


def test_counts_with_orphans_nulls_repeats_and_empty_files(spark, small, scratch):
    """Rows without partner, null keys, repeated dimension rows, no events."""
    t = Tables(spark, scratch)
    null = F.lit(None)
    changed = {
        "orders": small.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, null).when(F.col("o_orderkey") % 7 == 0, -1)
                                          .otherwise(F.col("o_custkey"))).withColumn(
            "o_orderdate", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate"))),
        "customer": small.customer.filter("c_custkey % 3 > 0").unionByName(small.customer.filter("c_custkey % 4 = 1"))
        .withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 > 0, F.col("c_nationkey"))),
        "nation": small.nation.unionByName(small.nation.limit(3)), "region": small.region.limit(3),
        "part": small.part.filter("p_partkey % 2 = 0").unionByName(small.part.filter("p_partkey % 8 = 0")),
        "lineitem": small.lineitem.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 9 > 0, F.col("l_suppkey"))),
        "events": small.events.filter("false")}
    for name, df in changed.items():
        df.write.parquet(f"{scratch}/{name}.parquet")
    got = {r.table_name: r.num_rows for r in S.row_counts(t).collect()}
    assert got == _true(t) and got["charger_telemetry"] == 0


def test_at_most_one_scan_per_driver_file(small):
    plan = S.schema_catalog(small)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [")
    assert scans == 7, plan


def test_keys_are_dealt_over_tasks_that_follow_the_rows(spark, monkeypatch):
    """Twice the rows take twice the tasks, so that a task's keys do not grow;
    null keys join nothing, a null second key is one of its own."""
    monkeypatch.setattr(S, "KEYS_PER_TASK", 50)
    for times in (1, 2):
        left = spark.range(200 * times).selectExpr(
            "IF(id % 20 = 0, NULL, id % 40) AS key", "IF(id % 3 = 0, NULL, id % 5) AS sub").unionByName(
                spark.createDataFrame([(7, 1), (7, 1), (7, None), (99, 4)], "key bigint, sub bigint"))
        right = spark.createDataFrame([(7, 3), (7, 4), (8, 3), (None, 3), (500, None)], "key bigint, sub bigint")
        found = S._beside(left, right)
        others = {7: 2, 8: 1, 500: 1, None: 1}
        expected = Counter((side, *r) for side, df in enumerate((left, right)) for r in df.collect())
        assert Counter({tuple(r)[:3]: r.n for r in found.select("side", "key", "sub", "n").collect()}) == expected
        assert all(r.others == others.get(r.key, 0) for r in found.collect())
        exchange = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "REPARTITION_BY_NUM" in line]
        assert len(exchange) == 1 and f", {-(-(left.count() + 5) // 50)})" in exchange[0]
