"""Preservation of evidence: what a written page must still contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.dedup import keep_first
from folioforge.operators.registry import query
from folioforge.sources.tables import table


def missing_evidence(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence(path, kind, text) that is no substring of its page; pages(path, body). Blank evidence is never missing."""
    e = evidence.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    return e.join(pages.select("path", "body"), "path").where(~F.contains(F.col("body"), F.col("text"))).select("path", "kind", "text")


def missing_citations(pages: DataFrame, citations: DataFrame) -> DataFrame:
    """citations(path, key) whose marker is not on the page."""
    marker = F.concat(F.lit("[^"), "key", F.lit("]"))
    return citations.join(pages.select("path", "body"), "path").where(~F.contains(F.col("body"), marker)).select("path", "key")


def off_map_citations(pages: DataFrame, citations: DataFrame) -> DataFrame:
    """``(path, key, line, text)``: keys on a page that its map doesn't have, with the first line each is on; a definition alone counts too."""
    lines = pages.select("path", F.posexplode(F.split("body", "\n", -1)).alias("line", "text"))
    keys = lines.select("path", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[\^(src\d+)\]"), F.lit(1))).alias("at", "key"))
    off = keys.join(citations.select("path", "key").distinct(), ["path", "key"], "left_anti")
    return keep_first(off, ["path", "key"], ["line", "at"]).select("path", "key", (F.col("line") + 1).alias("line"), "text")


def section_of(body: Column | str, file: Column, page: Column) -> Column:
    """The ``## Table:`` section that names a file and page, or null."""
    parts = F.split(T.col(body), r"(?m)^(?=## )")
    fits = lambda p: p.startswith("## Table:") & F.contains(p, T.base_name(file)) & F.regexp_like(p, F.concat(F.lit(r"p\. "), page.cast("string"), F.lit(r"\b")))
    return F.get(F.filter(parts, fits), F.lit(0))


def missing_row_values(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """``(path, file, page, subject, value)`` of tables(path, file, page, markdown): row subjects (value null) and numbers that
    the table's section, or where it has none the page, doesn't contain. A missing subject speaks for its numbers."""
    t = tables.join(pages.select("path", "body"), "path")
    scope = F.coalesce(section_of("body", F.col("file"), F.col("page")), F.col("body"))
    # outer explodes: for inner ones Spark adds a filter by the size of the list, which makes each list twice
    r = t.select("path", "file", "page", scope.alias("scope"), F.explode_outer(T.row_values("markdown")).alias("row")).where("row is not null")
    gone = ~F.contains(F.col("scope"), F.col("row.subject"))
    value = lambda v: F.struct(v.alias("value"))
    numbers = F.transform(F.filter("row.values", lambda v: ~F.contains(F.col("scope"), v)), value)
    missing = F.when(gone, F.array(value(F.lit(None).cast("string")))).when(~gone, numbers)
    return r.select("path", "file", "page", F.col("row.subject").alias("subject"), F.explode_outer(missing).alias("m")).where("m is not null").select("path", "file", "page", "subject", "m.value")


def feedback(findings: DataFrame) -> DataFrame:
    """``(path, feedback)``: one text for each page of findings(path, what), in order, for another attempt."""
    line = F.concat(F.lit("- Missing from the page: "), "what")
    return findings.select("path", line.alias("l")).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("l")), "\n").alias("feedback"))


def row_finding(file: Column, page: Column, subject: Column, value: Column) -> Column:
    where = F.format_string('%s, p. %s row "%s"', T.base_name(file), page.cast("string"), subject)
    return F.when(value.isNull(), where).otherwise(F.concat(where, F.lit(': value "'), value, F.lit('"')))


@query("preservation_contains", "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def preservation_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that a document has word for word.

    A text may go on with letters where an item begins or ends, but has every word inside the item among its words, so the
    pairs to test are joined on the longest of them. Items without one are compared with all documents.
    """
    parts = F.split("text", r"[^\p{L}\p{N}]+")
    inner = F.transform(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), F.array_max(inner)["w"].alias("w"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("w"))
    pairs = words.join(items.select("item_id", "w"), "w").select("doc_id", "item_id").distinct()
    found = pairs.join(items.where("w is not null").select("item_id", "item"), "item_id").join(docs, "doc_id").where(F.contains(F.col("text"), F.col("item"))).select("item_id", "doc_id")
    short = docs.join(F.broadcast(items.where("w is null").select("item_id", "item")), F.contains(F.col("text"), F.col("item"))).select("item_id", "doc_id")
    return found.unionByName(short)


@query(
    "first_marker_line",
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
    select doc_id, min(i)::int as line, arg_min(line, i) as text from l where contains(line, '@') group by doc_id""",
)
def first_marker_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document with an address on it."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.replace("text", F.lit("@"), F.lit("@[^src0]")).alias("body"))
    off = off_map_citations(pages, spark.createDataFrame([], "path bigint, key string"))
    return off.select(F.col("path").alias("doc_id"), F.col("line").cast("int").alias("line"), F.replace("text", F.lit("@[^src0]"), F.lit("@")).alias("text"))
