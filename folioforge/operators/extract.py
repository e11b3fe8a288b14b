"""Extraction records: reading, parsing, normalising and checking what an extractor returned for each chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T

RECORD = (
    "entities array<struct<name: string, type: string, slug: string, folder: string, significance: string, disambiguation: string, mentions: array<struct<page: int, context: string>>>>,"
    " relationships array<struct<subject: string, predicate: string, object: string, evidence: string, page: int>>,"
    " claims array<struct<text: string, type: string, entities: array<string>, page: int>>,"
    " timeline array<struct<date: string, event: string, entities: array<string>>>,"
    " tables array<struct<subject: string, title: string, page: int, rowDimension: string, colDimension: string, entities: array<string>, markdown: string, summary: string>>,"
    " context string"
)


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies(chunk_id, reply) to the record's columns and ``ok``: false where the reply, without fences, is no JSON object."""
    b = replies.select("chunk_id", T.strip_fences("reply").alias("body"))
    r = b.select("chunk_id", F.from_json("body", RECORD).alias("r"), (F.get_json_object("body", "$").startswith("{")).alias("j"))
    return r.select("chunk_id", "r.*", F.coalesce("j", F.lit(False)).alias("ok"))


def _slugs(xs: Column, lang: str | None) -> Column:
    return F.transform(xs, lambda x: T.slugify(x, lang))


def normalise(records: DataFrame, lang: str | None = None) -> DataFrame:
    """Slugs where slugs belong: entity slugs, each folder segment, both ends of relationships, entity lists, claim types, table subjects. Predicates stay."""
    folder = lambda f: F.array_join(_slugs(F.split(f, "/"), lang), "/")
    s = lambda x: T.slugify(x, lang)
    return (
        records.withColumn("entities", F.transform("entities", lambda e: e.withField("slug", s(e["slug"])).withField("folder", folder(e["folder"]))))
        .withColumn("relationships", F.transform("relationships", lambda r: r.withField("subject", s(r["subject"])).withField("object", s(r["object"]))))
        .withColumn("claims", F.transform("claims", lambda c: c.withField("entities", _slugs(c["entities"], lang)).withField("type", s(c["type"]))))
        .withColumn("timeline", F.transform("timeline", lambda t: t.withField("entities", _slugs(t["entities"], lang))))
        .withColumn("tables", F.transform("tables", lambda t: t.withField("subject", s(t["subject"])).withField("entities", _slugs(t["entities"], lang))))
    )


def issues_of(records: DataFrame, pages: Column) -> Column:
    """The violations of a record that covers ``pages``, as array(struct(field, issue, level)); see ``schema_issues``."""
    span = T.page_range(pages)
    outside = lambda p: p.isNull() | (span.isNotNull() & ~p.between(span["min"], span["max"]))
    bad_slug = lambda x: ~F.coalesce(x.rlike("^[a-z0-9-]+$"), F.lit(False))
    bad_folder = lambda f: ~F.coalesce(f.rlike("^(entities|topics)/"), F.lit(False)) | F.exists(F.split(f, "/"), lambda p: p.isin("", "..")) | (F.size(F.split(f, "/")) > 4)
    blank = lambda x: F.coalesce(T.strip(x), F.lit("")) == ""
    row = lambda field, issue, level: F.struct(field.alias("field"), F.lit(issue).alias("issue"), F.lit(level).alias("level"))
    there = lambda rows: F.filter(rows, lambda v: v.isNotNull())

    def each(section: str, rules: Callable[[Column], dict[str, Column]], level: str = "error") -> Column:
        def of(x: Column, i: Column) -> Column:
            at = F.concat(F.lit(section + "["), i.cast("string"), F.lit("]"))
            return there(F.array(*[F.when(c, row(at, n, level)) for n, c in rules(x).items()]))

        return F.coalesce(F.flatten(F.transform(section, of)), F.array().cast("array<struct<field:string,issue:string,level:string>>"))

    out = [
        each("entities", lambda x: {"bad slug": bad_slug(x["slug"]), "bad folder": bad_folder(x["folder"]), "name is missing": blank(x["name"]), "type is missing": blank(x["type"]), "significance is missing": blank(x["significance"]), "page outside the chunk": F.exists(x["mentions"], lambda m: outside(m["page"]))}),
        each("relationships", lambda x: {"bad slug": bad_slug(x["subject"]) | bad_slug(x["object"]), "predicate is missing": blank(x["predicate"]), "page outside the chunk": outside(x["page"])}),
        each("claims", lambda x: {"text is missing": blank(x["text"]), "entities is no list": x["entities"].isNull(), "page outside the chunk": outside(x["page"])}),
        each("timeline", lambda x: {"event is missing": blank(x["event"]), "entities is no list": x["entities"].isNull()}),
        each("tables", lambda x: {"title is missing": blank(x["title"]), "page outside the chunk": outside(x["page"])}),
        each("tables", lambda x: {"unknown entity": F.exists(x["entities"], lambda e: ~F.array_contains(F.col("entities.slug"), e))}, "warning"),
    ]
    missing = lambda c: row(F.lit(c), "is missing", "error")
    gone = there(F.array(*[F.when(F.col(c).isNull(), missing(c)) for c in ("entities", "relationships", "claims", "timeline", "context")]))
    whole = F.when(~F.coalesce(F.col("ok"), F.lit(True)), F.array(missing("record"))).otherwise(gone) if "ok" in records.columns else gone
    return F.concat(*out, whole)


def schema_issues(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(chunk_id, field, issue, level)`` of records joined to chunks(chunk_id, pages): one row for each violation.

    A page must lie in the chunk's range, which an unreadable range leaves open; a folder is under entities/ or topics/,
    of at most four segments, none empty and none ``..``; slugs are lower-case words; sections must be there. A table
    that names an unknown entity is a warning. All rules are tried in one pass over the records.
    """
    r = records.join(chunks.select("chunk_id", F.col("pages").alias("__pages")), "chunk_id", "left")
    return r.select("chunk_id", F.explode(issues_of(records, F.col("__pages"))).alias("x")).select("chunk_id", "x.*")
