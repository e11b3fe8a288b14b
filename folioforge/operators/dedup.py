"""Keep-first deduplication and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.registry import query
from folioforge.sources.tables import table


def keep_first(df: DataFrame, key: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by ``order``, which must be total. ``dropDuplicates`` would keep an arbitrary row."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


@query(
    "doc_keep_first",
    "select doc_id, lang, source, n_chars from documents qualify row_number() over (partition by text order by doc_id) = 1",
)
def doc_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the 32-byte digest is shuffled instead of the text
    slim = docs.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    return keep_first(slim, ["digest"], ["doc_id"]).drop("digest")


@query("doc_fingerprint", "select doc_id, sha256(text) as digest from documents")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sha256("text").alias("digest"))
