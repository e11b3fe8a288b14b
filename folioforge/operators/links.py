"""The link graph over pages: universe, resolution, degrees, broken links, orphans, islands, citations, schema, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.dedup import keep_first
from folioforge.operators.registry import query
from folioforge.operators.scalar import TITLE
from folioforge.sources.tables import table

PAGE_TYPES = ("entity", "topic", "composite", "comparison", "document", "source", "index", "workspace")


def universe(pages: DataFrame) -> DataFrame:
    """``(key, path)`` of pages(path): a page is known by its path without extension, by the slug of its file name, and an
    index also by its folder's name where no page has that slug. The first path wins a slug."""
    stem = F.regexp_replace("path", r"\.md$", "")
    by_path = pages.select(stem.alias("key"), "path", F.lit(0).alias("rank"))
    by_slug = pages.select(T.slugify(T.base_name(stem)).alias("key"), "path", F.lit(1).alias("rank"))
    folder = T.base_name(F.regexp_replace("path", r"/?index\.md$", ""))
    by_index = pages.where(F.col("path").rlike(r"(^|/)index\.md$")).select(folder.alias("key"), "path", F.lit(2).alias("rank"))
    every = by_path.unionByName(by_slug).unionByName(by_index).where("key <> ''")
    return keep_first(every, ["key"], ["rank", "path"]).select("key", "path")


def page_links(pages: DataFrame) -> DataFrame:
    """One row for each occurrence: ``(path, pos, link, target, display)`` of pages(path, body)."""
    at = pages.select("path", F.posexplode(T.wikilinks("body")).alias("pos", "link"))
    return at.withColumn("target", T.wikilink_target("link")).withColumn("display", T.wikilink_display("link"))


def resolve_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links`` with ``to``, the page of its target: by exact key, else by the target's slug; null where neither is known."""
    exact = known.select(F.col("key").alias("target"), F.col("path").alias("__a"))
    slug = known.select(F.col("key").alias("__s"), F.col("path").alias("__b"))
    return links.join(exact, "target", "left").withColumn("__s", T.slugify("target")).join(slug, "__s", "left").withColumn("to", F.coalesce("__a", "__b")).drop("__a", "__b", "__s")


def degrees(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(path, outgoing, incoming)`` over all pages; links to the page itself count."""
    out = resolved.groupBy("path").agg(F.count(F.lit(1)).alias("outgoing"))
    into = resolved.where("to is not null").groupBy(F.col("to").alias("path")).agg(F.count(F.lit(1)).alias("incoming"))
    return pages.select("path").join(out, "path", "left").join(into, "path", "left").select("path", F.coalesce("outgoing", F.lit(0)).cast("bigint").alias("outgoing"), F.coalesce("incoming", F.lit(0)).cast("bigint").alias("incoming"))


def broken(resolved: DataFrame) -> DataFrame:
    return resolved.where("to is null").select("path", "pos", "target")


def orphans(degree: DataFrame) -> DataFrame:
    return degree.where((F.col("incoming") == 0) & ~F.col("path").endswith("index.md") & ~F.col("path").startswith("sources/")).select("path")


def islands(degree: DataFrame) -> DataFrame:
    return degree.where((F.col("outgoing") == 0) & F.col("path").rlike("^(entities|topics|comparisons)/") & ~F.col("path").endswith("index.md")).select("path")


def citation_issues(pages: DataFrame, raw_files: DataFrame) -> DataFrame:
    """``(path, key, issue)`` of pages(path, body, sources: array(file)), raw_files(file).

    A cited key without a definition, or with a blank one, is invalid; a defined file that isn't among the raw files is a
    missing source; on entity and topic pages a marker in the text whose file isn't in the page's sources is missing from
    the frontmatter. Of several definitions the last counts.
    """
    p = pages.where(~F.col("path").endswith("index.md"))
    keys = p.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\^(src\d+)\]"), F.lit(1)))).alias("key"))
    pattern = r"\[\^(src\d+)\]:\s*(.+)"
    names, texts = (F.regexp_extract_all("body", F.lit(pattern), F.lit(i)) for i in (1, 2))
    defs = p.select("path", F.posexplode(F.arrays_zip(names.alias("key"), texts.alias("text"))).alias("pos", "d")).select("path", F.col("d.key").alias("key"), F.col("d.text").alias("text"), "pos")
    defs = keep_first(defs, ["path", "key"], [F.desc("pos")]).drop("pos").withColumn("file", T.citation_file("text"))
    cited = keys.join(defs, ["path", "key"], "left").join(raw_files.select("file").distinct().withColumn("raw", F.lit(True)), "file", "left")
    bad = F.when(F.coalesce(T.strip("text"), F.lit("")) == "", "invalid").when(F.col("raw").isNull(), "missing source")
    marked = p.where(F.col("path").rlike("^(entities|topics)/")).select("path", "sources", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\^(src\d+)\](?!:)"), F.lit(1)))).alias("key"))
    front = marked.join(defs, ["path", "key"]).where(~F.array_contains("sources", F.col("file"))).select("path", "key", F.lit("missing in frontmatter").alias("issue"))
    return cited.select("path", "key", bad.alias("issue")).where("issue is not null").unionByName(front)


def schema_issues(pages: DataFrame) -> DataFrame:
    """``(path, issue)`` of pages(path, title, type, updated, members: array, class)."""
    n = F.coalesce(F.size("members"), F.lit(-1))
    composite = F.col("type") == "composite"
    rules = {
        "title is missing": F.coalesce(T.strip("title"), F.lit("")) == "",
        "type is unknown": ~F.coalesce(F.col("type").isin(*PAGE_TYPES), F.lit(False)),
        "updated is no ISO timestamp": ~T.is_iso_timestamp("updated"),
        "composite needs 2 to 4 members": composite & ~n.between(2, 4),
        "composite needs class 1 to 5": composite & ~F.coalesce(F.col("class").between(1, 5), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return pages.select("path", F.explode(found).alias("issue"))


def repair_targets(unresolved: DataFrame, slugs: DataFrame, aliases: DataFrame, lang: str | None = None) -> DataFrame:
    """``(target, to, rule, candidates)``: a target that is the prefix of one slug only becomes that slug; else one that is
    the alias (as a slug of the wiki's language) of one page only; else the sorted candidates are reported.

    Each slug is joined by its own prefixes: an equi join, whatever they begin with.
    """
    t = unresolved.select("target").distinct().where("target <> ''")
    s = slugs.select("slug").where("slug <> ''").distinct()
    pre = s.select("slug", F.explode(F.transform(F.sequence(F.lit(1), F.length("slug")), lambda n: F.substr("slug", F.lit(1), n))).alias("target"))
    pre = pre.join(t, "target").groupBy("target").agg(F.array_sort(F.collect_set("slug")).alias("p"))
    al = t.withColumn("a", T.slugify("target", lang)).join(aliases.select(T.slugify("alias", lang).alias("a"), "slug"), "a").groupBy("target").agg(F.array_sort(F.collect_set("slug")).alias("q"))
    both = t.join(pre, "target", "left").join(al, "target", "left")
    none = F.array().cast("array<string>")
    rule = F.when(F.size("p") == 1, "prefix").when((F.size("q") == 1) & (F.coalesce(F.size("p"), F.lit(0)) < 1), "alias")
    to = F.when(rule == "prefix", F.col("p")[0]).when(rule == "alias", F.col("q")[0])
    every = F.array_sort(F.array_union(F.coalesce("p", none), F.coalesce("q", none)))
    return both.select("target", to.alias("to"), rule.alias("rule"), F.when(rule.isNull(), every).otherwise(none).alias("candidates"))


def repair_pages(pages: DataFrame, repairs: DataFrame) -> DataFrame:
    """pages(path, body) whose body is repaired: only targets are rewritten, displays stay."""
    links = page_links(pages).select("path", "target").distinct()
    maps = links.join(repairs.where("to is not null").select("target", "to"), "target").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", "to"))).alias("m"))
    return pages.join(maps, "path").select("path", T.rewrite_links("body", F.col("m")).alias("body"))


def repair_report(pages: DataFrame, known: DataFrame, slugs: DataFrame, aliases: DataFrame, lang: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A dry run over the entity and topic pages of pages(path, body) but indexes: ``(path, target, to, candidates, outcome)``, a row
    for each broken target, repaired or unrepairable, and for each page without one (unchanged); and the bodies to write with
    their hash, for the ledger of page hashes."""
    scope = pages.where(F.col("path").rlike("^(entities|topics)/") & ~F.col("path").endswith("index.md"))
    lost = resolve_links(page_links(scope), known).where("to is null and target <> ''").select("path", "target").distinct()
    r = repair_targets(lost, slugs, aliases, lang)
    rows = lost.join(r, "target").select("path", "target", "to", "candidates", F.when(F.col("to").isNull(), "unrepairable").otherwise("repaired").alias("outcome"))
    calm = scope.select("path").join(lost.select("path").distinct(), "path", "left_anti")
    none = F.lit(None).cast("string")
    report = rows.unionByName(calm.select("path", none.alias("target"), none.alias("to"), F.array().cast("array<string>").alias("candidates"), F.lit("unchanged").alias("outcome")))
    return report, repair_pages(scope, r).withColumn("hash", F.sha2("body", 256))


def canonical_links(pages: DataFrame, known: DataFrame, titles: DataFrame) -> DataFrame:
    """pages(path, body) of which every link is a known key (kept), a unique title (made a link to its key, shown as before) or plain text."""
    one = titles.groupBy(F.lower("title").alias("t")).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).where("n = 1")
    links = page_links(pages).select("path", "target").distinct()
    by = links.join(known.select(F.col("key").alias("target"), F.lit(True).alias("ok")), "target", "left").withColumn("t", F.lower("target")).join(one, "t", "left")
    maps = by.where("ok is null").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", F.coalesce("key", F.lit("")).alias("to")))).alias("m"))
    body = T.rewrite_links("body", F.col("m"), F.transform_values("m", lambda k, _: k))
    plain = F.regexp_replace(F.regexp_replace(body, r"\[\[\|([^\]]*)\]\]", "$1"), r"\[\[\]\]", "")
    return pages.join(maps, "path", "left").select("path", F.when(F.col("m").isNull(), F.col("body")).otherwise(plain).alias("body"))


def catalog_gaps(required: DataFrame, linked: DataFrame) -> DataFrame:
    """required(path, target) that are not in linked(path, target)."""
    return required.join(linked.select("path", "target").distinct(), ["path", "target"], "left_anti")


def has_section(body: Column | str, heading: str, level: int = 2) -> Column:
    return T.col(body).rlike(rf"(?mi)^{'#' * level}\s+\Q{heading}\E\s*$")


def proposal_ok(text: Column | str) -> Column:
    """A proposed guide is kept with 200 characters and three headings or more."""
    x = T.col(text)
    return (F.length(x) >= 200) & (F.regexp_count(x, F.lit(r"(?m)^#{1,6}\s")) >= 3)


def validation_summary(broken_rows: DataFrame, orphan_rows: DataFrame, island_rows: DataFrame, citations: DataFrame, schema: DataFrame) -> DataFrame:
    """``(check, n)`` of all checks, with nothing found as 0."""
    named = {"broken links": broken_rows, "orphans": orphan_rows, "islands": island_rows, "citations": citations, "schema": schema}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- queries: the universe is the slugs of the first word of each page's title, links are the hrefs

_U = "select page_id, trim(regexp_replace(lower(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ')[1]), '[^a-z0-9]+', '-', 'g'), '-') as slug from pages"
_H = "select page_id, trim(regexp_replace(lower(unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))), '[^a-z0-9]+', '-', 'g'), '-') as target from pages"
_CTE = f"with u0 as ({_U}), u as (select slug, min(page_id) as to_page from u0 where slug <> '' group by slug), h as ({_H}), r as (select h.*, u.to_page from h left join u on u.slug = h.target)"


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slugify(F.split(F.regexp_extract("html", TITLE, 1), " ")[0]).alias("slug"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("href"))
    first = _universe(spark, sf_dir).where("slug <> ''").groupBy(F.col("slug").alias("target")).agg(F.min("page_id").alias("to_page"))
    return pages.select("page_id", T.slugify("href").alias("target")).join(first, "target", "left")


@query("slug_collision_first_wins", f"with u as ({_U}) select page_id, slug from u where slug <> '' qualify row_number() over (partition by slug order by page_id) = 1")
def slug_collision_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(_universe(spark, sf_dir).where("slug <> ''"), ["slug"], ["page_id"])


@query("link_resolution", f"{_CTE} select page_id, target, to_page, count(*)::bigint as n from r group by all")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("page_id", "target", "to_page").agg(F.count(F.lit(1)).alias("n"))


_DEGREE = f"""{_CTE}, d as (select p.page_id, coalesce(o.n, 0)::bigint as outgoing, coalesce(i.n, 0)::bigint as incoming from pages p
  left join (select page_id, count(*) as n from r where to_page is not null group by 1) o on o.page_id = p.page_id
  left join (select to_page, count(*) as n from r where to_page is not null group by 1) i on i.to_page = p.page_id)"""


def _degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir).where("to_page is not null").select(F.col("page_id").cast("string").alias("path"), F.col("to_page").cast("string").alias("to"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"))
    return degrees(pages, r).select(F.col("path").cast("bigint").alias("page_id"), "outgoing", "incoming")


@query("link_degree", f"{_DEGREE} select * from d")
def link_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree(spark, sf_dir)


@query("broken_links", f"{_CTE} select target, count(*)::bigint as n from r where to_page is null group by target")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("to_page is null").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("orphans", f"{_DEGREE} select page_id from d where incoming = 0")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree(spark, sf_dir).where("incoming = 0").select("page_id")


@query("islands", f"{_DEGREE} select page_id from d where outgoing = 0")
def island_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree(spark, sf_dir).where("outgoing = 0").select("page_id")


@query(
    "prefix_repair",
    f"""{_CTE}, t as (select distinct target from r where to_page is null and target <> ''), p as (select t.target, count(*) as n, min(u.slug) as slug, string_agg(u.slug, ' ' order by u.slug) as every
    from t join u on starts_with(u.slug, t.target) group by 1)
    select t.target, case when n = 1 then slug end as "to", case when n = 1 then 'prefix' end as rule, case when n > 1 then every else '' end as candidates from t left join p using (target)""",
)
def prefix_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    unresolved = _resolved(spark, sf_dir).where("to_page is null")
    slugs = _universe(spark, sf_dir).where("slug <> ''")
    none = spark.createDataFrame([], "alias string, slug string")
    return repair_targets(unresolved, slugs, none).withColumn("candidates", F.array_join("candidates", " "))
