"""Shared-folder helpers: work folders, written tables and raw files.

Every intermediate goes to the folder named by ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


_OWN: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for an unset setting on a local master."""
    global _OWN
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    # the setting cannot be changed in a running session
    _OWN = _OWN or "file://" + tempfile.mkdtemp(prefix="sitelens-")
    return _OWN


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder URI of this run's own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written by Spark's reliable checkpoint, with its lineage cut."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed Parquet table of the shared folder and read again."""
    return _table(df, f"{_SCRATCH.get()}/{name}-{uuid.uuid4().hex[:12]}" if _SCRATCH.get() else work_dir(df.sparkSession, name))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Like ``written``, but outlasting the ``scratch`` block around it."""
    return _table(df, work_dir(df.sparkSession, name))


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written inside the block go to a folder of its own, which is deleted at the block's end.

    What the block returns must be written by ``kept`` inside it.
    """
    folder = work_dir(spark, name)
    before = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this run's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a URI (``file:``, ``hdfs:``, ``s3:``, ``gs:``); a bare path is local."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, attempt: str, chunks) -> int:
    """Write ``chunks`` to ``uri`` by way of a file of this attempt, renamed when complete.

    A repeated or speculative task writes the same bytes to another temporary
    name, so the last rename wins and no reader sees half a file.
    """
    fs, path = file_system(uri)
    parent = path.rsplit("/", 1)[0]
    fs.create_dir(parent, recursive=True)
    partial = f"{parent}/_{attempt}-{uuid.uuid4().hex[:8]}"
    size = 0
    with fs.open_output_stream(partial) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(partial, path)
    return size


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
