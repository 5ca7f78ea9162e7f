"""Spark session settings used by tests and the bench.

On a cluster the session is created by the platform; the library only reads
settings from it.  ``checkpoint_dir`` returns the shared folder named by
``spark.checkpoint.dir``.  Where the setting is absent it makes a scratch
folder in local mode (tests, bench) and raises on a cluster.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Local test defaults.  Shuffle partitions ~ cores for local[N]; on a cluster
# AQE coalesces the configured partition count to what the data needs.
_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": os.environ.get("LEDGERLINE_TZ", "UTC"),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "ledgerline") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder from the session; in local mode one is made if
    it is unset."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join(tempfile.mkdtemp(prefix="ledgerline-ckpt-"), "ckpt")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured
