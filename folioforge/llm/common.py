"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Rows in an Arrow batch: few, as a single text can be long. The setting is the session's and changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``ids(__id)``; all columns of ``docs`` stay, rows without a doc_id too."""
    return docs.join(ids.select(F.col("__id").alias("__drop_id")), docs["doc_id"] == F.col("__drop_id"), "left_anti")


def retext(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text, and ``n_chars``, where there is such a column, brought up to date."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
