"""Corpus-wide line deduplication.

Normalised lines are exploded and hashed; a hash in more than ``max_docs`` distinct documents is dropped wherever it
occurs, and each text is put together again from the lines that stay, in their positions. Only 16-byte hashes and ids
are shuffled for the count. What comes back to a document is the list of its own hashes to drop, so the text itself
moves once at most (never, where Spark finds the lists small enough to broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import retext, same, table

#: Distinct documents that a line may be in.
MAX_DOCS = 50


def normal_line(line: Column) -> Column:
    """Lower case, with runs of blanks and tabs as one blank and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), "[ \t\r\f\u000b ]+", " "))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(normal_line(line)))


def drop_lists(docs: DataFrame, max_docs: int = MAX_DOCS, keep_first: bool = False) -> DataFrame:
    """``(__id, __drop)``: for each document that has any, the hashes of its lines that are in more than ``max_docs`` documents."""
    lines = docs.select(F.col("doc_id").alias("__id"), F.explode(F.split("text", "\n", -1)).alias("line"))
    hashes = lines.where(normal_line(F.col("line")) != "").select("__id", _hash(F.col("line")).alias("hash"))
    once = hashes.distinct()
    often = once.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("least")).where(F.col("n") > max_docs).select("hash", "least")
    found = once.join(often, "hash")
    if keep_first:
        found = found.where(~same(F.col("__id"), F.col("least")))
    return found.groupBy("__id").agg(F.collect_list("hash").alias("__drop"))


def dedup_lines(docs: DataFrame, max_docs: int = MAX_DOCS, keep_first: bool = False) -> DataFrame:
    """All documents and columns, the text without the lines that more than ``max_docs`` distinct documents have.

    Blank lines never count and always stay. A document whose every line goes stays, with an empty text; a null text
    stays null. A line repeated inside a document counts once. Rows that repeat a doc_id count as one document and lose
    the same lines; rows without a doc_id count together as one document. Ties cannot arise: a line goes everywhere or
    nowhere. With ``keep_first`` the document of the least doc_id among a line's holders keeps it, so that a text copied
    more often than ``max_docs`` is left whole in one place.
    """
    lists = drop_lists(docs.select("doc_id", "text"), max_docs, keep_first)
    joined = docs.join(lists, same(docs["doc_id"], lists["__id"]), "left")
    stays = F.filter(F.split("text", "\n", -1), lambda x: (normal_line(x) == "") | ~F.array_contains("__drop", _hash(x)))
    return retext(joined, F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))).select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)


_NORM = "trim(regexp_replace(lower(line), '[ \t\r\f\u000b ]+', ' ', 'g'), ' ')"
ORACLE = f"""
with l as (select doc_id, pos, line, {_NORM} as norm from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
often as (select norm from (select distinct doc_id, norm from l where norm <> '') group by norm having count(*) > {MAX_DOCS}),
kept as (select doc_id, string_agg(line, chr(10) order by pos) as text from l where norm not in (select norm from often) group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text from documents d left join kept k using (doc_id)"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {"op10_line_dedup": ORACLE}
