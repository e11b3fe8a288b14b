"""Ingestion: status of sources by content hash, page-range chunks, plain-text tables, warnings, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.registry import query
from folioforge.sources.tables import table

PAGES_PER_CHUNK = 5


def source_status(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(slug, hash, known_hash, status)``: new, changed, unchanged or removed; files(slug, hash), ledger(slug, hash)."""
    known = ledger.select("slug", F.col("hash").alias("known_hash"))
    status = F.when(F.col("hash").isNull(), "removed").when(F.col("known_hash").isNull(), "new").when(F.col("hash") == F.col("known_hash"), "unchanged").otherwise("changed")
    return files.select("slug", "hash").join(known, "slug", "full").withColumn("status", status)


def to_process(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose content the ledger doesn't have: skipped before anything expensive."""
    return files.join(ledger.select("slug", "hash"), ["slug", "hash"], "left_anti")


def chunk_pages(pages: DataFrame, per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """pages(source, page_no, text) to ``(source, chunk_id, chunk_ord, pages, body)``; pages are never split."""
    k = F.floor((F.col("page_no") - 1) / per_chunk).cast("int")
    one = F.struct(F.col("page_no").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    g = pages.groupBy("source", k.alias("k")).agg(F.array_sort(F.collect_list(one)).alias("p"))
    first, last = F.col("p")[0]["n"], F.element_at("p", -1)["n"]
    span = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
    number = F.lpad((F.col("k") + 1).cast("string"), 3, "0")
    return g.select("source", F.concat(T.source_slug("source"), F.lit("-part-"), number).alias("chunk_id"), (F.col("k") + 1).alias("chunk_ord"), span.alias("pages"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("body"))


def empty_page_warnings(pages: DataFrame) -> DataFrame:
    return pages.where(T.strip(F.coalesce("text", F.lit(""))) == "").select("source", "page_no", F.format_string("Page %d extracted to empty text", F.col("page_no").cast("int")).alias("warning"))


def drop_stale(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks but those of changed sources, which are made anew."""
    return chunks.join(changed.select("source"), "source", "left_anti")


def language_warning(chosen: str, last: str | None, has_extractions: bool) -> str | None:
    if last and chosen != last and has_extractions:
        return f"Language changed from {last} to {chosen}; earlier extractions stay in {last}"
    return None


def extraction_counters(records: DataFrame, *more: str) -> DataFrame:
    """``(chunk_id, entities, relationships, claims, claimsByType)`` of extraction records: sizes, and claims by their type; and the columns ``more``."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c)  # noqa: E731  (the size of null is null)
    types = F.array_sort(F.array_distinct(F.filter(F.transform("claims", lambda c: c["type"]), lambda t: t.isNotNull())))
    by = F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.size(F.filter("claims", lambda c: c["type"] == t)).cast("bigint"))))
    counted = records.withColumn("claimsByType", F.coalesce(by, F.create_map().cast("map<string,bigint>")))
    return counted.select("chunk_id", *map(size, ("entities", "relationships", "claims")), "claimsByType", *more)


def table_lines(lines: DataFrame) -> DataFrame:
    """Gaps and islands over lines(doc, pos, line): ``run``, ``run_len`` and ``digits_after`` of lines that could be table rows.

    A candidate has two tokens or more, no list mark, none of ``, ; :``, and no token ending in a full stop. A run is
    neighbouring candidates of equally many tokens; ``digits`` is how many lines at its end hold a digit.
    """
    t = F.split(T.strip("line"), r"\s+")
    plain = ~F.col("line").rlike(r"^\s*([-*+•]|\d+[.)])\s") & ~F.col("line").rlike(r"[,;:]") & ~F.col("line").rlike(r"\.(\s|$)") & (F.size(t) >= 2)
    w = Window.partitionBy("doc").orderBy("pos")
    a = lines.withColumn("tokens", t).withColumn("width", F.when(plain, F.size(t)).otherwise(0))
    a = a.withColumn("new", (F.coalesce(F.lag("width").over(w), F.lit(-1)) != F.col("width")).cast("int"))
    a = a.withColumn("run", F.sum("new").over(w))
    r = Window.partitionBy("doc", "run")
    a = a.withColumn("run_len", F.count(F.lit(1)).over(r))
    last_plain = F.max(F.when(~F.col("line").rlike(r"\d"), F.col("pos"))).over(r)
    end = F.max("pos").over(r)
    return a.withColumn("digits", F.when(last_plain.isNull(), F.col("run_len")).otherwise(end - last_plain)).withColumn("run_pos", F.col("pos") - F.min("pos").over(r))


def detect_tables(lines: DataFrame) -> DataFrame:
    """``(doc, body, tables_found)``: runs of three lines or more with at least two digit lines at the end become Markdown
    tables, headed by the line before the digit lines; lines before that stay text."""
    a = table_lines(lines)
    is_table = (F.col("width") >= 2) & (F.col("run_len") >= 3) & (F.col("digits") >= 2)
    head = F.greatest(F.col("run_len") - F.col("digits") - 1, F.lit(0))
    row = F.concat(F.lit("| "), F.array_join(F.transform("tokens", lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    out = F.when(is_table & (F.col("run_pos") == head), F.concat(row, F.lit("\n"), rule)).when(is_table & (F.col("run_pos") > head), row).otherwise(F.col("line"))
    shown = a.withColumn("out", out).withColumn("heads", (is_table & (F.col("run_pos") == head)).cast("int"))
    g = shown.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("p"), F.sum("heads").cast("bigint").alias("tables_found"))
    return g.select("doc", F.array_join(F.transform("p", lambda x: x["out"]), "\n").alias("body"), "tables_found")


# ---- queries

_STATUS_SQL = """
with files as (select doc_id as slug, sha256(text) as hash from documents where lang <> 'es'),
ledger as (select doc_id as slug, sha256(case when lang = 'de' then text || '.' else text end) as hash from documents where lang <> 'fr')
select coalesce(f.slug, l.slug) as slug, f.hash as hash, l.hash as known_hash,
  case when f.hash is null then 'removed' when l.hash is null then 'new' when f.hash = l.hash then 'unchanged' else 'changed' end as status
from files f full join ledger l on f.slug = l.slug"""


@query("incremental_status", _STATUS_SQL)
def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger knows no French documents, other German ones, and Spanish ones that are gone by now."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    files = docs.where("lang <> 'es'").select(F.col("doc_id").alias("slug"), F.sha2("text", 256).alias("hash"))
    was = F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return source_status(files, docs.where("lang <> 'fr'").select(F.col("doc_id").alias("slug"), F.sha2(was, 256).alias("hash")))


@query(
    "chunk_pages",
    f"""select 'conv ' || conv_id as source, 'conv-' || conv_id || '-part-' || lpad((turn // {PAGES_PER_CHUNK} + 1)::varchar, 3, '0') as chunk_id,
    (turn // {PAGES_PER_CHUNK} + 1)::int as chunk_ord,
    case when min(turn) = max(turn) then (min(turn) + 1)::varchar else (min(turn) + 1)::varchar || '-' || (max(turn) + 1)::varchar end as pages,
    string_agg(text, chr(10) order by turn) as body from conversations group by conv_id, turn // {PAGES_PER_CHUNK}""",
)
def chunk_pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("source"), (F.col("turn") + 1).alias("page_no"), "text")
    return chunk_pages(pages)


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")  # line numbers repeat
    rows = li.select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("bigint").alias("pos"), F.concat_ws(" ", "l_returnflag", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("line"))
    heads = li.select(F.col("l_orderkey").alias("doc"), F.lit(0).cast("bigint").alias("pos"), F.lit("flag part supplier").alias("line")).distinct()
    return rows.unionByName(heads)


_TABLE_SQL = r"""
with lines as (select l_orderkey as doc, (row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_partkey, l_suppkey))::bigint as pos, l_returnflag || ' ' || l_partkey || ' ' || l_suppkey as line from lineitem
  union all select distinct l_orderkey, 0::bigint, 'flag part supplier' from lineitem),
a as (select *, string_split(line, ' ') as tokens, len(string_split(line, ' ')) as width from lines),
b as (select *, case when coalesce(lag(width) over w, -1) <> width then 1 else 0 end as new from a window w as (partition by doc order by pos)),
c as (select *, sum(new) over (partition by doc order by pos) as run from b),
d as (select *, count(*) over r as run_len, max(case when not regexp_matches(line, '\d') then pos end) over r as last_plain, max(pos) over r as last, pos - min(pos) over r as run_pos from c window r as (partition by doc, run)),
e as (select *, case when last_plain is null then run_len else last - last_plain end as digits from d),
f as (select *, width >= 2 and run_len >= 3 and digits >= 2 as is_table, greatest(run_len - digits - 1, 0) as head, '| ' || array_to_string(tokens, ' | ') || ' |' as row from e)
select doc, string_agg(case when is_table and run_pos = head then row || chr(10) || '|' || repeat(' --- |', width) when is_table and run_pos > head then row else line end, chr(10) order by pos) as body,
  sum(case when is_table and run_pos = head then 1 else 0 end)::bigint as tables_found from f group by doc"""


@query("table_runs", _TABLE_SQL)
def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_tables(_order_lines(spark, sf_dir))


@query("empty_page_warnings", "select 'conv ' || conv_id as source, turn + 1 as page_no, 'Page ' || (turn + 1) || ' extracted to empty text' as warning from conversations where starts_with(text, 'L')")
def empty_page_warnings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that start with L play the empty ones, as the table has none."""
    c = table(spark, sf_dir, "conversations")
    return empty_page_warnings(c.select(F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("source"), (F.col("turn") + 1).alias("page_no"), F.when(~F.col("text").startswith("L"), F.col("text")).alias("text")))


@query("counters_by_type", "select event_type, count(*)::bigint as n, count(distinct user_id)::bigint as users from events group by event_type")
def counters_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
