"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tonewise", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; shuffle partitions, memory and master stay with the caller's cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset, a cluster's folders lie in its warehouse, which executors share too. Only a
    master on this machine alone (``local`` or ``local[n]``) falls back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            shared = tempfile.mkdtemp(prefix="tonewise-")
        else:
            shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Hash-partition by ``key`` when the scan has fewer partitions than there are cores.

    A single small file is otherwise read by one task. On a real table the scan already has far
    more partitions than cores, so the plan is left alone and the wide rows are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)
