"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "sitelens", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests.  On a cluster, use the cluster's session.

    AQE stays on so shuffle partitions coalesce and skewed joins split at run
    time; Arrow is on for the rare pandas paths.
    """
    master = master or os.environ.get("SITELENS_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SITELENS_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The private folder of this process, for a local master without the setting (which a running session cannot change).
_OWN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only on a local master (tests) is a private folder created for an absent
    setting; a cluster must name storage that driver and executors share.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="sitelens-ckpt-"))
        d = _OWN[0]
    spark.sparkContext.setCheckpointDir(d)
    return d


#: Folders of the tables that ``materialize`` wrote without a name, until ``release``.
_TABLES: list[str] = []


def materialize(df: DataFrame, name: str | None = None, key: str | None = None) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Cuts lineage and plan for work that feeds several outputs, and survives
    lost executors (the files live on shared storage, not on an executor).
    Without a ``name`` the table is this session's own and goes with ``release``.

    With a ``key`` the table is bucketed and sorted by it, in as many buckets as
    there are shuffle partitions, so joins and groups by the key need no exchange.
    The rows should be partitioned by the key already, or every task
    writes a file for every bucket.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name or 'own-' + uuid.uuid4().hex}"
    if not name:
        _TABLES.append(path)
    if key is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"sitelens_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets(spark), key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Delete the unnamed tables of ``materialize``; frames that read them cannot be used any more."""
    while _TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
