"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.registry import query
from folioforge.sources.tables import table

TITLE = r"<title>([^<]*)</title>"
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("slugify_pages", f"select page_id, {_SLUG.format(f'regexp_extract(html, {TITLE!r}, 1)')} as slug from pages")
def slugify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slugify(F.regexp_extract("html", TITLE, 1)).alias("slug"))


def _transliterate_sql() -> str:
    out = "case"
    for lang in T.LANGUAGES:
        x = "text"
        for letter, spelled in T.DIGRAPHS[lang].items():
            upper = letter.upper() if letter != "ß" else "ẞ"
            x = f"replace(replace({x}, '{letter}', '{spelled}'), '{upper}', '{spelled[0].upper() + spelled[1:]}')"
        out += f" when lang = '{lang}' then translate({x}, '{T._ACCENTED}', '{T._BASE}')"
    return f"select doc_id, {out} end as text from documents"


@query("transliterate_docs", _transliterate_sql())
def transliterate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.lit(None).cast("string")
    for lang in reversed(T.LANGUAGES):
        out = F.when(F.col("lang") == lang, T.transliterate("text", lang)).otherwise(out)
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("text"))


@query("titlecase_slug", "select p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(w[1]) || w[2:]), ' ') as title from part")
def titlecase_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


@query("truncate_samples", "select doc_id, case when length(text) > 200 then text[1:197] || '...' else text end as sample from documents")
def truncate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_sample("text").alias("sample"))


@query("json_props", "select event_id, (props->>'$.k')::bigint as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("bucket_stems", r"select p_partkey, regexp_replace(array_to_string(list_transform(string_split(lower(replace(p_name, ' ', '-') || '-' || p_size), '-'), lambda p: case when length(p) > 3 and p like '%s' then p[1:length(p) - 1] else p end), '-'), '(.)(-\d+)+$', '\1') as stem from part")
def bucket_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.bucket_stem(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"))).alias("stem"))


@query("iso_timestamps", "select event_id, event_type <> 'error' as valid, false as short_valid from events")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of errors are in a month 13."""
    form = lambda month: F.date_format("ts", f"yyyy-{month}-dd'T'HH:mm:ss.SSS'Z'")
    iso = F.when(F.col("event_type") == "error", form("'13'")).otherwise(form("MM"))
    return table(spark, sf_dir, "events").select("event_id", T.is_iso_timestamp(iso).alias("valid"), T.is_iso_timestamp(F.substring(iso, 1, 19)).alias("short_valid"))


@query(
    "row_value_numbers",
    r"""select l_orderkey, l_linenumber, l_returnflag as subject, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') as numbers
    from (select *, regexp_extract_all(l_partkey || ' | ' || l_suppkey || ' | ' || l_quantity::bigint, '\d+') as u from lineitem)""",
)
def row_value_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    md = F.concat(F.lit("| flag | part | supplier | quantity |\n| --- | --- | --- | --- |\n| "), F.concat_ws(" | ", "l_returnflag", "l_partkey", "l_suppkey", "q"), F.lit(" |"))
    row = T.row_values(md)[0]
    return li.select("l_orderkey", "l_linenumber", row["subject"].alias("subject"), F.array_join(row["values"], " ").alias("numbers"))
