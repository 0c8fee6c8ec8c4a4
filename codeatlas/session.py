"""Session helpers.

Cluster settings come from the cluster; these defaults only apply when a key is
unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Return the active session or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("codeatlas")
    builder = builder.master(master or "local[8]")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CODEATLAS_DRIVER_MEM", "16g"))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_table(df, name: str, partition_by: str | None = None, tables: list[str] | None = None):
    """Cut lineage by writing a parquet table into the shared checkpoint folder
    and reading it back: later scans get column pruning, pushed filters and
    (with ``partition_by``) partition pruning, which a checkpointed RDD scan
    does not offer. ``tables`` takes the folder down, for who removes it."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if tables is not None:
        tables.append(path)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def clustered_table(df, name: str, by: list[str], sort_by: str | None = None, buckets: int | None = None, tables: list[str] | None = None, dealt: bool = False):
    """Like ``cut_table``, with the rows of equal ``by`` in one bucket: joins,
    groupings and windows whose keys include ``by`` then read the table without
    an exchange. Rows are dealt by ``by`` before they are written, so that each
    task writes one bucket and one file; with ``dealt`` they come so already (from
    tables of as many buckets). ``sort_by`` orders a file's rows, so that filters
    on it skip pages."""
    import uuid
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"codeatlas_{name}_{uuid.uuid4().hex}"
    if tables is not None:
        tables.append(table)
    w = (df if dealt else df.repartition(buckets, *by)).write.bucketBy(buckets, *by)
    if sort_by:
        w = w.sortBy(sort_by)
    w.format("parquet").option("path", f"{checkpoint_dir(spark)}/tables/{table}").saveAsTable(table)
    return spark.table(table)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there). Only when it is unset (local runs, tests) a scratch folder
    is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="codeatlas-ckpt-", dir=os.environ.get("CODEATLAS_SCRATCH", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001 - some deployments lock core settings
        pass
    spark.sparkContext.setCheckpointDir(local)
    return local
