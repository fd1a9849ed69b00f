"""Cutting lineage with tables in the shared checkpoint folder.

Iterative operators write each round as Parquet below ``spark.checkpoint.dir`` and go on
from the files, so a lost executor costs the running round only. The folder is read from
the session; only a purely local session without that setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: list[str] = []
_written: list[str] = []
_registered: list[bool] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Raises ``RuntimeError`` on a cluster without ``spark.checkpoint.dir``: a folder of one
    machine would lose data with that machine.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="braidwork-"))
        atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
    return f"file://{_local_dirs[0]}"


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder; return the table read back and its row count."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/braidwork/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    _written.append(path)
    _remember(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table, int(seen.get["n"] or 0)


def discard(*tables: DataFrame) -> None:
    """Delete tables of earlier rounds, as :func:`materialize` returned them, once nothing reads them any more."""
    for table in tables:
        path = table.__dict__.pop("_written", None)
        if path in _written:
            _written.remove(path)
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all tables written so far. Call it when no result of this session is needed any more.

    What is left at the end of the process is deleted then.
    """
    while _written:
        _delete(spark, _written.pop())


def _remember(spark: SparkSession) -> None:
    """Have :func:`release` run once at the end of the process, if the session is still there."""
    if _registered:
        return
    _registered.append(True)

    def last() -> None:
        try:
            release(spark)
        except Exception:  # the session or its JVM has gone; the folder's owner cleans up
            pass

    atexit.register(last)
