"""Incremental ingestion as a stream of files.

The checkpoint knows which files were read; the hash ledger knows which contents were, which a file source can't tell, as
it goes by path and time. Each micro-batch is idempotent: a batch that runs again finds its own hashes in the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.dedup import keep_first
from folioforge.operators.ingest import to_process

LEDGER = "slug string, hash string, ingestedAt timestamp"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(path)
    return keep_first(rows, ["slug"], [F.desc("ingestedAt"), "hash"])


def ingest_stream(spark: SparkSession, source: DataFrame, ledger: str, checkpoint: str, process: Callable[[DataFrame, int], None]):
    """Start a query that hands the rows of ``source(slug, text, ...)`` with new or changed content to ``process``, takes all
    there is, and stops. The ledger is appended to after ``process`` is done."""
    def batch(df: DataFrame, n: int) -> None:
        hashed = df.withColumn("hash", F.sha2("text", 256))
        fresh = to_process(hashed, read_ledger(spark, ledger)).persist()
        try:
            process(fresh, n)
            fresh.select("slug", "hash", F.current_timestamp().alias("ingestedAt")).distinct().write.mode("append").parquet(ledger)
        finally:
            fresh.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
