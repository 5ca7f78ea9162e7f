"""Sinks (A7-A11) and seed rows.

Tables that several writers share (A8, A11) are committed tables
(``sources.commits``): files are staged and become visible with a numbered
manifest, so readers never see half a write, a writer that dies leaves nothing
visible and two writers at once keep the sealing rule.  Hot values (one issue
date or one loop holding much of the data) are spread over several files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog

DEFAULT_VIEW = "primary_view"
ARTIFACT_FILES = 8  # files of an artifact folder


# A7
def publish_view(df: DataFrame, domain: str | None = None, names: dict[str, str] | None = None) -> str:
    """Create or replace a named view; the name comes from ``names[domain]``,
    default ``primary_view``."""
    name = (names or {}).get(domain or "", DEFAULT_VIEW)
    df.createOrReplaceTempView(name)
    return name


# A8
def write_partitioned(df: DataFrame, root: str, date_col: str, cluster_cols: list[str], id_col: str,
                      replace: bool = False) -> int:
    """Date-partitioned, clustered table: one folder per month of
    ``date_col``, rows sorted by day and the cluster columns inside each file.
    Tasks take ranges of (day, hash of ``id_col``) of about equal size: a task
    writes few folders, and a hot day is many tasks.  Appends a version or
    replaces all rows with one; the version is returned."""
    month = F.date_format(F.col(date_col), "yyyy-MM")
    rows = (df.withColumn(f"{date_col}_month", F.coalesce(month, F.lit("none")))
            .repartitionByRange(F.col(date_col), F.hash(id_col))
            .sortWithinPartitions(f"{date_col}_month", date_col, *cluster_cols))
    log = CommitLog(df.sparkSession, root)
    if not replace:
        return log.append(rows, [f"{date_col}_month"])
    folder = log.stage(rows, [f"{date_col}_month"])
    version = log.latest()
    while not log.commit(version + 1, [folder], log.live(version)):
        version = log.latest()
    return version + 1


def write_invoices(invoices: DataFrame, root: str, replace: bool = False) -> int:
    return write_partitioned(invoices, root, "issue_date", ["currency", "status"], "invoice_id", replace)


def write_rates(rates: DataFrame, root: str, replace: bool = False) -> int:
    return write_partitioned(rates, root, "rate_date", ["target_currency"], "target_currency", replace)


# A9
SEED_INVOICES = [
    ("INV-2026-001", "ACC-001", "1250.00", "EUR", "PAID", "2026-08-01", "2026-08-15"),
    ("INV-2026-002", "ACC-002", "8400.50", "USD", "PAID", "2026-08-02", "2026-08-16"),
    ("INV-2026-003", "ACC-003", "3100.00", "GBP", "PAID", "2026-08-03", "2026-08-17"),
    ("INV-2026-004", "ACC-004", "500.00", "EUR", "PENDING", "2026-08-10", "2026-08-24"),
]


def seed_invoices(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(SEED_INVOICES, "invoice_id string, account_id string, amount string, currency string, "
                                              "status string, issue_date string, due_date string")
    return df.select("invoice_id", "account_id", F.col("amount").cast("decimal(18,2)").alias("amount"),
                     "currency", "status", F.to_date("issue_date").alias("issue_date"),
                     F.to_date("due_date").alias("due_date"))


def seed_rates(spark: SparkSession) -> DataFrame:
    from .adapters import SEED_RATES
    df = spark.createDataFrame(SEED_RATES, "rate_date string, base_currency string, target_currency string, rate string")
    return df.select(F.to_date("rate_date").alias("rate_date"), "base_currency", "target_currency",
                     F.col("rate").cast("double").alias("rate"))


# A10
def write_artifacts(records_with_content: DataFrame, root: str, mode: str = "append") -> None:
    """Artifact hierarchy ``processes/{domain}/{date}/...``: one folder per
    domain and day of creation, rows sorted by loop inside each file (the path
    of an artifact stays in its ``gcs_uri``).  A salt spreads a hot folder, or
    a hot loop in it, over several files."""
    salt = F.pmod(F.hash("artifact_id"), F.lit(ARTIFACT_FILES))
    (records_with_content.withColumn("created_date", F.to_date("created_at"))
     .repartition("domain", "created_date", salt)
     .sortWithinPartitions("domain", "created_date", "loop_id", "artifact_name")
     .write.mode(mode).partitionBy("domain", "created_date").parquet(f"{root}/processes"))


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """The hierarchy as it lies in the store: the rows of every file and the
    ``folder`` (domain/day) that holds it, from the file's path."""
    path = F.col("_metadata.file_path")
    rows = spark.read.parquet(f"{root}/processes")
    folder = F.concat(F.regexp_extract(path, "domain=([^/]+)/", 1), F.lit("/"), F.regexp_extract(path, "created_date=([^/]+)/", 1))
    return rows.select("*", folder.alias("folder"))


# A11
def append_telemetry(events: DataFrame, root: str) -> int:
    return CommitLog(events.sparkSession, root).append(events)


def append_audit(spark: SparkSession, records: DataFrame, root: str, key: str = "object_key",
                 order: tuple[str, ...] = ()) -> int:
    """Append audit records; a key already sealed at ``root`` is never
    replaced (left-anti join against the sealed keys).  Of a key repeated in
    ``records`` the first by ``order`` is sealed (without an order, the smallest
    row).  If another writer commits first, the staged records are compared
    with its keys before the next version is claimed."""
    names = records.columns
    by = F.struct(*[F.col(c) for c in (order or [c for c in names if c != key])])
    fresh = records.groupBy(key).agg(F.min_by(F.struct(*names), by).alias("first")).select("first.*")
    log = CommitLog(spark, root)
    seen = log.latest()
    sealed = log.frame(log.live(seen), records.schema)

    def unsealed(mine: DataFrame, theirs: DataFrame) -> DataFrame:
        return mine.join(theirs.select(key), key, "left_anti").select(*names)

    return log.append(fresh if sealed is None else unsealed(fresh, sealed), recheck=unsealed, seen=seen)
