"""Writers. Each is one Spark job whose commit makes the result visible at once; a path has one writer at a time."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, folder: str) -> None:
    """pages(path, page) as a Parquet table of pages, partitioned by section, so that a section can be read by itself."""
    pages.withColumn("section", F.substring_index("path", "/", 1)).write.mode("overwrite").partitionBy("section").parquet(folder)


def write_markdown(pages: DataFrame, folder: str) -> None:
    """pages(path, page) as files: each executor writes its own rows; for the folders that readers of Markdown want."""
    def save(rows) -> None:
        for r in rows:
            to = os.path.join(folder, r["path"])
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to + ".tmp", "w", encoding="utf-8") as f:
                f.write(r["page"])
            os.replace(to + ".tmp", to)  # a task that runs twice leaves one whole file

    pages.select("path", "page").foreachPartition(save)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """A new version of a ledger, written beside the old one and read by ``current_table`` from the moment it is whole.

    The version's number is one more than the last whole one's, so ``rows`` may read the ledger itself. An aborted write leaves
    a folder without the mark of success, which no reader takes; the next write goes over it. The old version stays until
    the next one but one, for who is still reading it.
    """
    spark = rows.sparkSession
    last = _last_version(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/v{last + 1:010d}")
    if last > 1:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{last - 1:010d}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def current_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last whole version of a ledger, or an empty table where there is none."""
    last = _last_version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{last:010d}") if last else spark.createDataFrame([], schema)


def _last_version(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return max((int(s.getPath().getParent().getName()[1:]) for s in found or []), default=0)


def add_source(path: str, raw: str) -> str:
    """Copy a PDF, given as pasted, into the folder of raw files; its name there. What is no PDF file is refused."""
    at = path.strip()
    while len(at) > 1 and at[0] == at[-1] and at[0] in "\"'":
        at = at[1:-1].strip()
    if not at.lower().endswith(".pdf"):
        raise ValueError(f"no PDF: {at}")
    if not os.path.isfile(at):
        raise FileNotFoundError(at)
    os.makedirs(raw, exist_ok=True)
    name = os.path.basename(at)
    shutil.copyfile(at, os.path.join(raw, name + ".tmp"))
    os.replace(os.path.join(raw, name + ".tmp"), os.path.join(raw, name))
    return name
