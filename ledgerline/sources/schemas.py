"""Typed domain tables and the schema catalog (A1-A4).

Declared schemas of the 15 domain tables: reference type names map to Spark
types; REQUIRED becomes ``nullable=False`` in the declared schema and is
enforced with a null-count check (Parquet reads come back nullable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapters import EVENTS_K

# ---------------------------------------------------------------------------
# Datasets, tables and declared columns (name, type).
# ---------------------------------------------------------------------------
CATALOG = {
    "finance_demo": {
        "invoices": [("invoice_id", "STRING"), ("account_id", "STRING"), ("amount", "NUMERIC"),
                     ("currency", "STRING"), ("status", "STRING"), ("issue_date", "DATE"), ("due_date", "DATE")],
        "exchange_rates": [("rate_date", "DATE"), ("base_currency", "STRING"), ("target_currency", "STRING"),
                           ("rate", "FLOAT64")],
        "billing_events": [("event_id", "STRING"), ("account_id", "STRING"), ("charger_id", "STRING"),
                           ("kwh_consumed", "FLOAT64"), ("event_timestamp", "TIMESTAMP")],
    },
    "sales_demo": {
        "opportunities": [("opp_id", "STRING"), ("account_name", "STRING"), ("amount_eur", "NUMERIC"),
                          ("stage", "STRING"), ("close_date", "DATE")],
        "accounts": [("account_id", "STRING"), ("region", "STRING"), ("tier", "STRING")],
        "lead_conversions": [("lead_id", "STRING"), ("converted_flag", "INT64"), ("conversion_timestamp", "TIMESTAMP")],
    },
    "firmware_demo": {
        "charger_telemetry": [("charger_id", "STRING"), ("firmware_version", "STRING"), ("voltage", "FLOAT64"),
                              ("current_amperes", "FLOAT64"), ("temperature_celsius", "FLOAT64"),
                              ("event_timestamp", "TIMESTAMP")],
        "firmware_releases": [("release_id", "STRING"), ("version", "STRING"), ("release_date", "DATE"),
                              ("status", "STRING")],
        "error_logs": [("log_id", "STRING"), ("charger_id", "STRING"), ("error_code", "STRING"),
                       ("severity", "STRING"), ("log_timestamp", "TIMESTAMP")],
    },
    "marketing_demo": {
        "campaign_events": [("event_id", "STRING"), ("campaign_id", "STRING"), ("channel", "STRING"),
                            ("user_id_hashed", "STRING"), ("event_type", "STRING"), ("event_timestamp", "TIMESTAMP")],
        "user_acquisitions": [("acquisition_id", "STRING"), ("campaign_id", "STRING"), ("cac_usd", "NUMERIC"),
                              ("converted_at", "TIMESTAMP")],
        "ad_spend": [("spend_id", "STRING"), ("channel", "STRING"), ("amount_usd", "NUMERIC"), ("spend_date", "DATE")],
    },
    "logistics_demo": {
        "inventory": [("part_id", "STRING"), ("warehouse_id", "STRING"), ("quantity_on_hand", "INT64"),
                      ("reorder_point", "INT64"), ("last_updated", "TIMESTAMP")],
        "warehouse_dispatch": [("dispatch_id", "STRING"), ("order_id", "STRING"), ("dispatch_time_hours", "FLOAT64"),
                               ("sla_target_hours", "FLOAT64"), ("status", "STRING")],
        "parts_catalog": [("part_id", "STRING"), ("part_name", "STRING"), ("category", "STRING"),
                          ("unit_cost_eur", "NUMERIC")],
    },
}
# Reference type -> Spark SQL type.  Money is decimal(18,2); timestamps stay
# zone-less (the driver files carry no zone).
SPARK_TYPES = {"STRING": "string", "NUMERIC": "decimal(18,2)", "FLOAT64": "double", "INT64": "bigint",
               "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
DOMAIN_DATASET = {d: f"{d}_demo" for d in ["finance", "sales", "firmware", "marketing", "logistics"]}
CONTEXT_TABLES = 3


def dataset_of(table: str) -> str:
    for ds, tables in CATALOG.items():
        if table in tables:
            return ds
    raise KeyError(f"Table '{table}' not found in any dataset.")


def struct_type(table: str) -> T.StructType:
    cols = CATALOG[dataset_of(table)][table]
    return T.StructType([T.StructField(n, T._parse_datatype_string(SPARK_TYPES[t]), nullable=False,
                                       metadata={"comment": f"{t} REQUIRED"}) for n, t in cols])


def typed(df: DataFrame, table: str) -> DataFrame:
    """A1: project an adapter/raw frame onto the declared typed schema."""
    cols = CATALOG[dataset_of(table)][table]
    return df.select(*[F.col(n).cast(SPARK_TYPES[t]).alias(n, metadata={"comment": f"{t} REQUIRED"})
                       for n, t in cols])


def required_nulls(df: DataFrame, table: str) -> DataFrame:
    """One row: NULL count per REQUIRED column (all must be 0)."""
    cols = [n for n, _ in CATALOG[dataset_of(table)][table]]
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def required_null_counts(tables) -> DataFrame:
    """REQUIRED enforcement over every domain table: one row per declared
    column with its NULL count (one aggregation per table, unpivoted)."""
    frames = []
    for ds, tbls in CATALOG.items():
        for tbl, cols in tbls.items():
            agg = typed(tables.get(tbl), tbl).agg(
                *[F.count_if(F.col(n).isNull()).alias(n) for n, _ in cols])
            long = agg.unpivot([], [n for n, _ in cols], "column_name", "null_count")
            frames.append(long.select(F.lit(ds).alias("dataset"), F.lit(tbl).alias("table_name"),
                                      "column_name", "null_count"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def catalog_frame(spark: SparkSession) -> DataFrame:
    rows = [(ds, tbl, i + 1, n, t, "REQUIRED")
            for ds, tables in CATALOG.items() for tbl, cols in tables.items() for i, (n, t) in enumerate(cols)]
    return spark.createDataFrame(
        rows, "dataset string, table_name string, pos int, column_name string, data_type string, mode string")


def list_tables(spark: SparkSession, dataset: str) -> DataFrame:
    """A2: tables of one dataset (unknown dataset -> no rows)."""
    return (catalog_frame(spark).filter(F.col("dataset") == dataset)
            .groupBy("dataset", "table_name").agg(F.count(F.lit(1)).alias("columns")))


def table_schema(spark: SparkSession, table: str, dataset: str) -> DataFrame:
    """A3: columns of a table; unknown table raises KeyError (driver-side
    check on the static catalog, not on data)."""
    if table not in CATALOG.get(dataset, {}):
        raise KeyError(f"Table '{table}' not found in dataset '{dataset}'.")
    return catalog_frame(spark).filter((F.col("dataset") == dataset) & (F.col("table_name") == table))


# How the rows of a table follow from counts per key of its driver files:
# plain tables add up, DISTINCT ones have so many rows per distinct key, JOINED
# ones the product of both sides' counts per key.  Opportunities are orders
# joined to customers, the inventory has one row per (part, warehouse) whose
# part is known: their files have nearly as many keys as rows, which are dealt
# over tasks of ``KEYS_PER_TASK`` rows.
_DISTINCT_ROWS = {"exchange_rates": 2, "firmware_releases": 1}
_JOINED = ["accounts"]
KEYS_PER_TASK = 250_000


def _shares(grouped: DataFrame, *shares: tuple[str, Column | None, int, str | None, str]) -> DataFrame:
    """Rows (table, side, key, n) of a file's counts for some tables: (table,
    condition, side, key column, column of the count)."""
    def number(name: str | None) -> Column:
        return (F.lit(None) if name is None else F.col(name)).cast("bigint")

    made = [F.when(F.lit(True) if cond is None else cond, F.struct(
        F.lit(table).alias("table_name"), F.lit(side).alias("side"), number(key).alias("key"), number(n).alias("n")))
        for table, cond, side, key, n in shares]
    return grouped.select(F.explode(F.filter(F.array(*made), lambda s: s.isNotNull())).alias("s")).select("s.*")


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """``side, key, sub, n, others``: the rows of ``left(key, sub)``, side 0,
    and of ``right(key, sub)``, side 1, counted by key and sub, beside the
    number of right rows with that key.  The number of tasks follows the rows,
    so that the keys that one task holds do not grow with them."""
    both = left.select(F.lit(0).alias("side"), "key", "sub").unionByName(right.select(F.lit(1).alias("side"), "key", "sub"))
    tasks = max(1, -(-(left.count() + right.count()) // KEYS_PER_TASK))
    counted = both.repartition(tasks, "key").groupBy("key", "side", "sub").agg(F.count(F.lit(1)).alias("n"))
    others = F.sum(F.when(F.col("side") == 1, F.col("n"))).over(Window.partitionBy("key"))
    return counted.withColumn("others", F.coalesce(others, F.lit(0)))


def row_counts(tables) -> DataFrame:
    """True number of rows of every domain table, from one pass over each
    driver file: its rows are counted per key that some table needs, and the
    tables' numbers follow from those counts.  No table is built, and no data
    column is read but the keys."""
    n = F.count(F.lit(1)).alias("n")
    events = tables.spark.sql(f"SELECT k % 4 AS version, event_type FROM {EVENTS_K}", events=tables.events)
    kind = F.col("event_type")
    nations = tables.nation.join(tables.region, F.col("n_regionkey") == F.col("r_regionkey"))
    left, right, keyed = F.col("side") == 0, F.col("side") == 1, F.col("key").isNotNull()

    def keys(df: DataFrame, key: str, sub: Column) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias("key"), sub.cast("bigint").alias("sub"))

    deals = _beside(keys(tables.orders, "o_custkey", F.year("o_orderdate")), keys(tables.customer, "c_custkey", F.col("c_nationkey")))
    deals = deals.groupBy("side", "sub").agg(F.sum("n").alias("n"), F.sum(F.when(left & keyed, F.col("n") * F.col("others"))).alias("joined"))
    stock = _beside(keys(tables.lineitem, "l_partkey", F.col("l_suppkey")), keys(tables.part, "p_partkey", F.lit(None)))
    stock = stock.groupBy("side").agg(F.sum("n").alias("n"), F.count_if(left & keyed & (F.col("others") > 0)).alias("known"))
    shares = [
        _shares(events.groupBy("version", "event_type").agg(n),
                ("charger_telemetry", None, 0, None, "n"), ("firmware_releases", None, 0, "version", "n"),
                ("billing_events", kind != "error", 0, None, "n"), ("campaign_events", kind != "error", 0, None, "n"),
                ("error_logs", kind == "error", 0, None, "n"), ("user_acquisitions", kind == "signup", 0, None, "n"),
                ("lead_conversions", kind.isin("signup", "purchase"), 0, None, "n")),
        _shares(deals, ("invoices", left, 0, None, "n"), ("exchange_rates", left, 0, "sub", "n"), ("opportunities", left, 0, None, "joined"),
                ("accounts", right & F.col("sub").isNotNull(), 0, "sub", "n")),
        _shares(stock, ("ad_spend", left, 0, None, "n"), ("warehouse_dispatch", left, 0, None, "n"), ("inventory", left, 0, None, "known"),
                ("parts_catalog", right, 0, None, "n")),
        _shares(nations.groupBy("n_nationkey").agg(n), ("accounts", None, 1, "n_nationkey", "n"))]
    every = shares[0]
    for s in shares[1:]:
        every = every.unionByName(s)
    per_key = every.groupBy("table_name", "key").agg(
        F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)).alias("others"))
    rows = F.when(F.col("table_name").isin(_JOINED), F.col("rows") * F.col("others"))
    for table, times in _DISTINCT_ROWS.items():
        rows = rows.when(F.col("table_name") == table, times)
    counted = per_key.groupBy("table_name").agg(F.sum(rows.otherwise(F.col("rows"))).alias("num_rows"))
    names = tables.spark.createDataFrame([(ds, t) for ds, tbls in CATALOG.items() for t in tbls], "dataset string, table_name string")
    return names.join(counted, "table_name", "left").select(
        "dataset", "table_name", F.coalesce("num_rows", F.lit(0)).cast("long").alias("num_rows"))


def schema_catalog(tables) -> DataFrame:
    cat = catalog_frame(tables.spark)
    return cat.join(row_counts(tables), ["dataset", "table_name"], "left")


def table_listing(tables) -> DataFrame:
    cat = catalog_frame(tables.spark).groupBy("dataset", "table_name").agg(F.count(F.lit(1)).alias("columns"))
    return cat.join(row_counts(tables), ["dataset", "table_name"], "left")


def schema_context(tables) -> DataFrame:
    """A4: per domain, "Table 't': col (TYPE), ..." for the first three
    tables of its dataset (catalog order), with their total row count."""
    spark = tables.spark
    order = [(ds, tbl, i + 1) for ds, tbls in CATALOG.items() for i, tbl in enumerate(tbls)]
    tpos = spark.createDataFrame(order, "dataset string, table_name string, table_pos int")
    dom = spark.createDataFrame(list(DOMAIN_DATASET.items()), "domain string, dataset string")
    cat = catalog_frame(spark).join(tpos, ["dataset", "table_name"]).filter(F.col("table_pos") <= CONTEXT_TABLES)
    per_table = cat.groupBy("dataset", "table_name", "table_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name", "data_type"))),
                                 lambda c: F.concat(c["column_name"], F.lit(" ("), c["data_type"], F.lit(")"))),
                     ", ").alias("cols"))
    per_table = per_table.join(row_counts(tables), ["dataset", "table_name"])
    lines = per_table.select("dataset", "table_pos", "num_rows",
                             F.concat(F.lit("Table '"), F.col("table_name"), F.lit("': "), F.col("cols")).alias("line"))
    ctx = lines.groupBy("dataset").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_pos", "line"))), lambda x: x["line"]),
                     "\n").alias("context"),
        F.sum("num_rows").alias("num_rows"))
    return dom.join(ctx, "dataset").select("domain", "dataset", "context", "num_rows")
