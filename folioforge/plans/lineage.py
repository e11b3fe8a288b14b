"""Cutting lineage with tables in the folder that all executors share.

A written table is computed once (``DataFrame.checkpoint`` computes its last stage twice) and, unlike a cached or
locally checkpointed one, survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder in local mode only; on a cluster
    a machine-local folder would not be seen by the other machines, so the setting is asked for."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="folioforge-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_table(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage before the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    to_delete(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def to_delete(spark: SparkSession, path: str) -> None:
    """The folder goes when the process ends."""
    _written[path] = spark


def release(df: DataFrame) -> None:
    """Delete the shared tables that ``df`` reads, before the process ends; what is computed from them can't be read again."""
    for file in df.inputFiles():
        for path in [p for p in _written if file.startswith(p) or file.split(":", 1)[-1].lstrip("/").startswith(p.split(":", 1)[-1].lstrip("/"))]:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the cluster's own retention applies
            return
