"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Sizes are left to the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew-join handling on and the web page off."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir`` of the session, else one below the warehouse.

    A warehouse on a local disk serves only where driver and executors are one process; on a cluster it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or _below_warehouse(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)


def _below_warehouse(warehouse: str, master: str) -> str:
    if warehouse.startswith(("file:", "/")) and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is on a local disk")
    return f"{warehouse.rstrip('/')}/_shared"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# What ``stage`` has written in this process and ``release`` has not yet removed.
_staged: list[str] = []


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for what is staged in several writes; ``release`` removes it."""
    _staged.append(fresh_path(spark, label))
    return _staged[-1]


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but is computed once and stays columnar, so later readers prune
    columns. A lost executor only costs the tasks it was running: the files outlive it. They stay until ``release``.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove everything staged so far and return how many folders that were.

    Call it when the results of the operators have been written or collected: frames that still read a staged copy
    cannot be used afterwards.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, removed = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _staged:
        path = hadoop.Path(_staged.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
