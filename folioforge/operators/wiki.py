"""Queries over pages, candidates, decisions and state made of the tables: link graph, resolution signals, curation, ledgers, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.linediff import diff_column
from folioforge.operators import curate as C
from folioforge.operators import ingest, links, render, resolve, state
from folioforge.operators.registry import query
from folioforge.operators.scalar import TITLE
from folioforge.sources import readers
from folioforge.sources.tables import table

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


def text(c: str):
    return F.col(c).cast("string")


def say(*parts):
    """Texts and columns in one string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- the link graph: web pages as pages of sections by language, their links as wikilinks

_PAGES = f"""with pg as (select page_id, case regexp_extract(html, '<html lang="([a-z]+)"', 1) when 'en' then 'entities' when 'fr' then 'topics' when 'de' then 'comparisons' else 'sources' end as section,
    {_SLUG.format("string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ')[1]")} as slug, regexp_extract_all(html, 'href="/([^"]*)"', 1) as hs from pages),
  p as (select section || '/' || page_id || '/' || slug || '.md' as path, hs from pg union all select distinct section || '/index.md', ['no such page']::varchar[] from pg),
  keys as (select left(path, length(path) - 3) as key, path, 0 as r from p union all select {_SLUG.format("string_split(left(path, length(path) - 3), '/')[-1]")}, path, 1 from p
    union all select string_split(regexp_replace(path, '/?index\\.md$', ''), '/')[-1], path, 2 from p where path like '%/index.md'),
  u as (select key, arg_min(path, row(r, path)) as path from keys where key <> '' group by key),
  ln as (select path, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as pos from p), lk as (select path, pos, trim(string_split(h, '|')[1]) as target from ln where h <> ''),
  rs as (select lk.*, coalesce(x.path, y.path) as "to" from lk left join u x on x.key = target left join u y on y.key = {_SLUG.format("target")}),
  d as (select p.path, coalesce(o.n, 0)::bigint as outgoing, coalesce(i.n, 0)::bigint as incoming from p left join (select path, count(*) as n from rs where "to" is not null group by 1) o using (path) left join (select "to" as path, count(*) as n from rs where "to" is not null group by 1) i using (path))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    section = F.when(lang == "en", "entities").when(lang == "fr", "topics").when(lang == "de", "comparisons").otherwise("sources")
    slug = T.slugify(F.split(F.regexp_extract("html", TITLE, 1), " ")[0])
    hrefs = F.filter(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda h: h != "")
    own = table(spark, sf_dir, "pages").select(section.alias("section"), say(section, "/", F.col("page_id"), "/", slug, ".md").alias("path"), F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("[["), h, F.lit("]]"))), " and ").alias("body"))
    index = own.select(say(F.col("section"), "/index.md").alias("path"), F.lit("[[no such page]]").alias("body")).distinct()
    return own.select("path", "body").unionByName(index)


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = _pages(spark, sf_dir)
    return pages, links.resolve_links(links.page_links(pages), links.universe(pages))


@query("wiki_universe", f"{_PAGES} select key, path from u")
def wiki_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.universe(_pages(spark, sf_dir))


@query("wiki_links", f'{_PAGES} select path, target, "to", count(*)::bigint as n from rs group by all')
def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[1].groupBy("path", "target", "to").agg(F.count(F.lit(1)).alias("n"))


@query("wiki_broken", f'{_PAGES} select path, target, count(*)::bigint as n from rs where "to" is null group by all')
def wiki_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.broken(_resolved(spark, sf_dir)[1]).groupBy("path", "target").agg(F.count(F.lit(1)).alias("n"))


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, r = _resolved(spark, sf_dir)
    return links.degrees(pages, r.where("to is not null"))


@query("wiki_orphans", f"{_PAGES} select path from d where incoming = 0 and path not like '%index.md' and path not like 'sources/%'")
def wiki_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.orphans(_degrees(spark, sf_dir))


@query("wiki_islands", f"{_PAGES} select path from d where outgoing = 0 and path not like '%index.md' and path not like 'sources/%'")
def wiki_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.islands(_degrees(spark, sf_dir))


_SCHEMA = """with s as (select c_custkey, case when c_nationkey % 5 = 0 then ' ' else c_name end as title, case when c_mktsegment = 'MACHINERY' then 'machine' when c_mktsegment = 'BUILDING' then 'composite' else 'entity' end as type,
    case when c_acctbal < 0 then '2024-01-01' else '2024-01-01T00:00:00.000Z' end as updated, c_nationkey % 6 as members, c_nationkey % 7 as class from customer),
  i as (select c_custkey, 'title is missing' as issue from s where trim(title) = '' union all select c_custkey, 'type is unknown' from s where type = 'machine' union all select c_custkey, 'updated is no ISO timestamp' from s where length(updated) = 10
    union all select c_custkey, 'composite needs 2 to 4 members' from s where type = 'composite' and members not between 2 and 4 union all select c_custkey, 'composite needs class 1 to 5' from s where type = 'composite' and class not between 1 and 5)"""


def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "machine").when(F.col("c_mktsegment") == "BUILDING", "composite").otherwise("entity")
    p = table(spark, sf_dir, "customer").select(text("c_custkey").alias("path"), F.when(n % 5 == 0, " ").otherwise(F.col("c_name")).alias("title"), kind.alias("type"), F.when(F.col("c_acctbal") < 0, "2024-01-01").otherwise("2024-01-01T00:00:00.000Z").alias("updated"), F.array_repeat(F.lit("m"), n % 6).alias("members"), (n % 7).alias("class"))
    return links.schema_issues(p)


@query("wiki_schema_issues", f"{_SCHEMA} select c_custkey::varchar as path, issue from i")
def wiki_schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schema(spark, sf_dir)


_CITATIONS = """with l as (select l_orderkey as o, l_linenumber as n, l_suppkey as s, l_returnflag as k, l_linestatus as t, l_partkey as a from lineitem), ck as (select distinct o, n from l), src as (select distinct o, s from l where t = 'F'),
  df as (select o, n, arg_max(s, row(s, a)) as s from l where k = 'R' group by o, n), raw as (select s_suppkey as s from supplier where s_acctbal > 0),
  ci as (select ck.o, 'src' || ck.n as key, case when df.s is null then 'invalid' when raw.s is null then 'missing source' end as issue from ck left join df using (o, n) left join raw on raw.s = df.s
    union all select o, 'src' || n, 'missing in frontmatter' from ck join df using (o, n) where (o, df.s) not in (select (o, s) from src))"""


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's page cites each line; lines returned are defined, by their supplier's file, the last of a number counting."""
    n, f = text("l_linenumber"), say("f", F.col("l_suppkey"), ".pdf")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", say("x [^src", n, "] y").alias("m"), F.when(F.col("l_returnflag") == "R", say("[^src", n, "]: ", f, ", pages 1")).alias("def"), F.when(F.col("l_linestatus") == "F", f).alias("src"))
    g = li.groupBy("l_orderkey").agg(F.collect_list("m").alias("m"), F.array_sort(F.collect_list(F.when(F.col("def").isNotNull(), F.struct("l_suppkey", "l_partkey", "def")))).alias("d"), F.collect_set("src").alias("sources"))
    pages = g.select(say("entities/", F.col("l_orderkey"), ".md").alias("path"), F.concat_ws("\n", "m", F.transform("d", lambda x: x["def"])).alias("body"), "sources")
    return links.citation_issues(pages, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(say("f", F.col("s_suppkey"), ".pdf").alias("file")))


@query("wiki_citation_issues", f"{_CITATIONS} select 'entities/' || o || '.md' as path, key, issue from ci where issue is not null")
def wiki_citation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(spark, sf_dir)


@query(
    "wiki_validation",
    f"""{_PAGES}, {_SCHEMA[5:]}, {_CITATIONS[5:]} select 'broken links' as "check", count(*)::bigint as n from rs where "to" is null union all select 'orphans', count(*) from d where incoming = 0 and path not like '%index.md' and path not like 'sources/%'
    union all select 'islands', count(*) from d where outgoing = 0 and path not like '%index.md' and path not like 'sources/%' union all select 'citations', count(*) from ci where issue is not null union all select 'schema', count(*) from i""",
)
def wiki_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _degrees(spark, sf_dir)
    return links.validation_summary(links.broken(_resolved(spark, sf_dir)[1]), links.orphans(d), links.islands(d), _citations(spark, sf_dir), _schema(spark, sf_dir))


_REPAIR = f"""{_PAGES}, sc as (select * from p where (path like 'entities/%' or path like 'topics/%') and path not like '%index.md'), lost as (select distinct path, target from rs join sc using (path) where "to" is null and target <> ''),
  sl as (select distinct string_split(left(path, length(path) - 3), '/')[-1] as slug from p where path not like '%index.md'), t as (select distinct target from lost),
  px as (select target, list_sort(list(slug)) as c from t join sl on starts_with(slug, target) and slug <> '' group by target)"""


@query(
    "wiki_repair_report",
    f"""{_REPAIR} select path, target, case when len(c) = 1 then c[1] end as "to", case when len(c) = 1 then '' else coalesce(array_to_string(c, ' '), '') end as candidates, case when len(c) = 1 then 'repaired' else 'unrepairable' end as outcome from lost left join px using (target)
    union all select path, null, null, '', 'unchanged' from sc where path not in (select path from lost)""",
)
def wiki_repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    slugs = pages.where(~F.col("path").endswith("index.md")).select(F.regexp_replace(T.base_name("path"), r"\.md$", "").alias("slug"))
    report, _ = links.repair_report(pages, links.universe(pages), slugs, spark.createDataFrame([], "alias string, slug string"))
    return report.withColumn("candidates", F.array_join("candidates", " "))


@query(
    "wiki_repaired_pages",
    f"""{_REPAIR}, f as (select path, pos, string_split(h, '|') as hh, h, trim(string_split(h, '|')[1]) as target from ln join sc using (path) where h <> ''),
  n as (select f.path, pos, case when len(c) = 1 and lost.target is not null then '[[' || c[1] || ']]' else '[[' || h || ']]' end as l, len(c) = 1 and lost.target is not null as ok from f left join lost on lost.path = f.path and lost.target = f.target left join px on px.target = f.target)
  select path, string_agg(l, ' and ' order by pos) as body from n group by path having bool_or(ok)""",
)
def wiki_repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    slugs = pages.where(~F.col("path").endswith("index.md")).select(F.regexp_replace(T.base_name("path"), r"\.md$", "").alias("slug"))
    return links.repair_report(pages, links.universe(pages), slugs, spark.createDataFrame([], "alias string, slug string"))[1].drop("hash")


@query(
    "wiki_canonical_links",
    f"""{_PAGES}, n as (select path, pos, case when target in (select key from u) then '[[' || h || ']]' else target end as l from (select path, pos, h, trim(string_split(h, '|')[1]) as target from ln where h <> '')) select path, string_agg(l, ' and ' order by pos) as body from n group by path
    union all select path, '' from p where path not in (select path from n)""",
)
def wiki_canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no key becomes plain text."""
    pages = _pages(spark, sf_dir)
    return links.canonical_links(pages, links.universe(pages), spark.createDataFrame([], "title string, key string"))


@query("wiki_catalog_gaps", "select o_custkey as path, o_orderpriority as target from (select distinct c_custkey as o_custkey, p as o_orderpriority from customer, (select distinct o_orderpriority as p from orders) where c_acctbal > 0) q where not exists (select 1 from orders o where o.o_custkey = q.o_custkey and o.o_orderpriority = q.o_orderpriority)")
def wiki_catalog_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities that a customer of positive balance has no order of."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("target"))
    five = o.agg(F.collect_set("target").alias("every"))  # one row
    want = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path")).crossJoin(F.broadcast(five)).select("path", F.explode("every").alias("target"))
    return links.catalog_gaps(want, o)


# ---- signals of entity resolution


def _cands(df: DataFrame) -> DataFrame:
    """(slug[, title, aliases]) in the order of the slugs."""
    out = df.distinct() if df.columns == ["slug"] else df
    for c, v in (("title", F.replace("slug", F.lit("-"), F.lit(" "))), ("aliases", F.array().cast("array<string>"))):
        out = out if c in out.columns else out.withColumn(c, v)
    return out.withColumn("pos", F.col("slug"))


_WORDS = "select distinct unnest(regexp_extract_all(lower(text), '[a-zäöüß]{6,}')) as w from documents"
_SPELLED = "replace(replace(replace(replace({}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_BARE = "replace(translate({}, 'äöü', 'aou'), 'ß', 'ss')"
_CANON = "replace(replace(replace(replace({}, 'ae', 'a'), 'oe', 'o'), 'ss', 's'), 'ue', 'u')"
_HAS = "(contains({0}, 'ae') or contains({0}, 'oe') or contains({0}, 'ue') or contains({0}, 'ss'))"


@query(
    "signal_transliteration",
    f"""with w as ({_WORDS}), c as (select distinct s from (select {_SPELLED.format("w")} as s from w union all select {_BARE.format("w")} from w) where length(s) >= 6), p as (select a.s as x, b.s as y from c a join c b on {_CANON.format("a.s")} = {_CANON.format("b.s")} and a.s < b.s)
    select case when {_HAS.format("y")} and not {_HAS.format("x")} then x else y end as "from", case when {_HAS.format("y")} and not {_HAS.format("x")} then y else x end as "into" from p""",
)
def signal_transliteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, spelled with digraphs and without."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüß]{6,}"), F.lit(0)))).alias("w")).distinct()
    bare = F.replace(F.translate("w", "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    return resolve.transliteration(_cands(w.select(T.slugify("w", "de").alias("slug")).union(w.select(bare))), "de").select("from", "into")


@query("signal_alias", "select 'customer-' || lpad(b.c_custkey::varchar, 9, '0') as \"from\", 'customer-' || lpad(a.c_custkey::varchar, 9, '0') as \"into\" from customer a join customer b on b.c_custkey = a.c_custkey + 1")
def signal_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer has the next one's name as an alias."""
    return resolve.alias(_customers(spark, sf_dir), "en").select("from", "into")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.array(say("Customer#", F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0")))
    return _cands(table(spark, sf_dir, "customer").select(T.slugify("c_name").alias("slug"), F.col("c_name").alias("title"), after.alias("aliases")))


@query("signal_abbreviation", "select distinct lower(string_split(p_name, ' ')[1][1] || string_split(p_name, ' ')[2][1]) as \"from\", replace(p_name, ' ', '-') as \"into\" from part")
def signal_abbreviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts introduce each part's name by its initials."""
    p = table(spark, sf_dir, "part").select("p_name", F.initcap("p_name").alias("t"), F.regexp_replace(F.initcap("p_name"), "[^A-Z]", "").alias("s"))
    c = _cands(p.select(T.slugify("p_name").alias("slug")).union(p.select(F.lower("s"))))
    return resolve.abbreviation(c, p.select(say("see the\n", F.col("t"), " (", F.col("s"), ") and (", F.lower("s"), ")").alias("text")), "en").select("from", "into")


_IND = """with c as (select distinct 'indikator-' || c_nationkey || '-' || lower(c_mktsegment) as slug, c_nationkey as n, lower(c_mktsegment) as name from customer union all select distinct 'indikator-' || c_nationkey, c_nationkey, null from customer union all select distinct 'indicator-' || c_nationkey, c_nationkey, null from customer)"""
_IND_PAIRS = """select case when a.name is null and b.name is not null then b.slug when b.name is null and a.name is not null then a.slug else greatest(a.slug, b.slug) end as "from", case when a.name is null and b.name is not null then a.slug when b.name is null and a.name is not null then b.slug else least(a.slug, b.slug) end as "into"
    from c a join c b on a.n = b.n and a.slug < b.slug where a.name is null or b.name is null or a.name = b.name"""


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(text("c_nationkey").alias("n"), F.lower("c_mktsegment").alias("m"))
    every = c.select(F.concat_ws("-", F.lit("indikator"), "n", "m").alias("slug")).union(c.select(say("indikator-", F.col("n")))).union(c.select(say("indicator-", F.col("n")))).union(c.select("m"))
    return _cands(every)


@query("signal_indicator_form", f"{_IND} {_IND_PAIRS}")
def signal_indicator_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.indicator_form(_indicators(spark, sf_dir)).select("from", "into")


@query("signal_indicator_clusters", f"{_IND} select slug || ' ' || name as members, slug as \"into\", 3 as class from c where name is not null")
def signal_indicator_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.indicator_clusters(_indicators(spark, sf_dir)).select(F.array_join("members", " ").alias("members"), "into", "class")


_NAMES = "with p as (select distinct string_split(p_name, ' ')[1] as x, string_split(p_name, ' ')[2] as y from part)"


@query("signal_initials", f"{_NAMES}, s as (select distinct x, y[1] as y from p) select p.x || '-' || p.y as \"from\", s.x || '-' || s.y as \"into\" from p join s on s.x = p.x and p.y[1] = s.y where p.x <> p.y")
def signal_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, and the same with an initial for the second word; none of their words repeats."""
    p = table(spark, sf_dir, "part").select(T.slugify("p_name").alias("slug"))
    short = F.concat_ws("-", F.substring_index("slug", "-", 1), F.substring(F.substring_index("slug", "-", -1), 1, 1))
    return resolve.initials(_cands(p.union(p.select(short))), "en").select("from", "into")


def _glossary_sql() -> str:
    rows = ", ".join(f"({i}, '{e}', '{d}')" for i, (e, d) in enumerate(x.strip().split(" = ") for x in resolve.GLOSSARY.replace("\n", ";").split(";") if x.strip()))
    da = _SLUG.format("replace(replace(replace(da, 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa')")
    return f"with g(i, en, da) as (values {rows}), c as (select distinct c_nationkey as i from customer) select {_SLUG.format('en')} as \"from\", {da} as \"into\" from g join c using (i)"


@query("signal_glossary", _glossary_sql())
def signal_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both terms of the domain's first rows, a row a nation with customers; the Danish one survives in a Danish wiki."""
    terms = resolve.glossary_terms(spark)
    seen = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group")).distinct()
    return resolve.glossary(_cands(terms.join(seen, "group").select("slug")), terms, "da").select("from", "into")


@query(
    "signal_detect",
    f"""{_IND}, i as ({_IND_PAIRS}), a as (select 'customer-' || lpad(y.c_custkey::varchar, 9, '0') as f, 'customer-' || lpad(x.c_custkey::varchar, 9, '0') as t from customer x join customer y on y.c_custkey = x.c_custkey + 1)
    select f as "from", t as "into", 'alias' as signal, case when t in (select 'customer-' || lpad(s_suppkey::varchar, 9, '0') from supplier) or f in (select 'customer-' || lpad(s_suppkey::varchar, 9, '0') from supplier) then 'vetoed' else 'auto' end as tier from a union all select "from", "into", 'indicator-form', 'proposed' from i""",
)
def signal_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals on customers and indicators together; pages of suppliers' numbers were edited by hand."""
    veto = table(spark, sf_dir, "supplier").select(say("customer-", F.lpad(text("s_suppkey"), 9, "0")).alias("slug"))
    c = _customers(spark, sf_dir).unionByName(_indicators(spark, sf_dir))
    return resolve.detect(c, "en", terms=resolve.glossary_terms(spark), veto=veto)[0]


# ---- curation: each nation's customers are judged in one reply

_JUDGED = """with c as (select c_nationkey as n, 'c-' || c_custkey as slug, c_mktsegment as m, c_acctbal as b from customer), lead as (select n, min(slug) as "into" from c group by n), mg as (select slug as "from", "into" from c join lead using (n) where b < 1000),
  dr as (select slug from c where m = 'MACHINERY'), kp as (select slug from c where b > 9000), named as (select "from" as slug from mg union select "into" from mg union select slug from dr union select slug from kp)"""


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_nationkey", say("c-", F.col("c_custkey")).alias("slug"), "c_mktsegment", "c_acctbal")
    pick = lambda cond, v: F.collect_list(F.when(cond, v))
    g = c.groupBy("c_nationkey").agg(pick(F.col("c_acctbal") < 1000, F.col("slug")).alias("f"), F.min("slug").alias("t"), pick(F.col("c_mktsegment") == "MACHINERY", F.struct("slug", F.lit("j").alias("justification"))).alias("drops"), pick(F.col("c_acctbal") > 9000, F.col("slug")).alias("keep"))
    merges = F.when(F.size("f") > 0, F.array(F.struct(F.col("f").alias("from"), F.col("t").alias("into"), F.lit("same").alias("justification")))).otherwise(F.array())
    raw = g.select(F.col("c_nationkey").alias("bucket"), say("```json\n", F.to_json(F.struct(merges.alias("merges"), "drops", "keep")), "\n```").alias("reply"))
    return C.parse_decisions(raw), c.where("c_mktsegment <> 'HOUSEHOLD'").select("slug")


@query(
    "curation_errors",
    f"""{_JUDGED}, kinds as (select "from" as slug, 'm' as k from mg union select slug, 'd' from dr union select slug, 'k' from kp)
    select slug, 'unknown slug' as error from named where slug not in (select slug from c where m <> 'HOUSEHOLD') union all select "into", 'merged into itself' from mg where "from" = "into" union all select slug, 'judged twice' from kinds group by slug having count(*) > 1
    union all select distinct "into", 'survivor is dropped' from mg where "into" in (select slug from dr)""",
)
def curation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decision_errors(*_decisions(spark, sf_dir))


@query("curation_merges", f"{_JUDGED} select \"from\", \"into\" from mg")
def curation_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_edges(_decisions(spark, sf_dir)[0])


_CHAIN = """with c as (select c_custkey as k, c_nationkey as n, lead(c_custkey) over (partition by c_nationkey order by c_custkey) as nx from customer), last as (select n, max(k) as l from c group by n)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("from"), F.lead("c_custkey").over(w).alias("into")).where("into is not null")


@query("curation_collapse", f"{_CHAIN} select k as old, l as new from c join last using (n) where k <> l")
def curation_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer merges into the next of its nation: all of them end at the last."""
    return C.collapse(_chain(spark, sf_dir))[0]


@query("curation_sticky", f"{_CHAIN} select k as old, l as new from c join last using (n) where k <> l")
def curation_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways recorded contradict each other; then the greatest survives, as nothing is rejected."""
    e = _chain(spark, sf_dir)
    return C.collapse(e.union(e.select("into", "from")), lenient=True)[0]


@query("curation_rejected", f"{_CHAIN} select min(k) as component, 'no unique survivor' as reason from c group by n having count(*) > 1")
def curation_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _chain(spark, sf_dir)
    return C.collapse(e.union(e.select("into", "from")))[1]


@query("curation_rounds", f"{_CHAIN}, r as (select l from last where l in (select s_suppkey from supplier)) select k as old, l as new from c join last using (n) where k <> l and l not in (select l from r)")
def curation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds: each but the last two goes to the last but one, that to the last; those of suppliers' numbers are dropped at last."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))).alias("r"))
    at = lambda r: c.where(f"r = {r}").select("n", F.col("k").alias("new"))
    first = c.where("r > 2").join(at(2), "n").select(F.col("k").alias("old"), "new")
    second = c.where("r = 2").join(at(1), "n").select(F.col("k").alias("old"), "new")
    return C.compose_rounds(first, second, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug")))[0]


@query(
    "curation_active",
    "select c_custkey as id from customer c where c_custkey not in (select s_suppkey from supplier where s_acctbal < 2000) and not exists (select 1 from supplier s where s_suppkey = c_custkey and s_nationkey = c_nationkey)",
)
def curation_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged into their nation; poor suppliers' numbers were split off since, and a supplier never merges with its nation."""
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("entities").alias("concern"), F.lit("merge").alias("action"), F.array(say("k-", F.col("c_custkey"))).alias("from"), say("n-", F.col("c_nationkey")).alias("into"))
    s = table(spark, sf_dir, "supplier").select(say("k-", F.col("s_suppkey")).alias("a"), say("n-", F.col("s_nationkey")).alias("b"), "s_acctbal")
    return C.active_records(r, s.where("s_acctbal < 2000").select(F.col("a").alias("slug")), s.select("a", "b")).select("id")


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of parts: those of low brands have another recorded hash, or none."""
    low = F.col("p_brand") < "Brand#2"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.lit("h").alias("hash"), F.when(~low, "h").when(F.col("p_size") > 25, "other").alias("recorded"))


@query(
    "curation_vetoes",
    """with e as (select p_partkey as slug from part where p_brand < 'Brand#2'), m as (select c_custkey as "from" from customer), cl as (select l_orderkey as o, list(distinct l_partkey) as ms from lineitem group by 1)
    select 'merge' as what, "from"::bigint as id from m where "from" in (select slug from e) union all select 'drop', s_suppkey from supplier where s_suppkey in (select slug from e) union all select 'cluster', l_orderkey from (select distinct l_orderkey from lineitem where l_partkey in (select slug from e))""",
)
def curation_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of customers' numbers, drops of suppliers' and clusters of orders' parts, as far as pages were edited by hand."""
    disk = _edited(spark, sf_dir)
    m = C.vetoed_by_edits(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("from"), F.lit(0).alias("into")), disk)
    d = C.drops_vetoed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug")), disk)
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("members"))
    c = C.clusters_vetoed(orders, disk)
    return m.select(F.lit("merge").alias("what"), F.col("from").alias("id")).union(d.select(F.lit("drop"), "slug")).union(c.select(F.lit("cluster"), "l_orderkey"))


@query("curation_topic_drops", "select event_id, event_type from events where event_type <> 'error'")
def curation_topic_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("slug"))
    return C.drop_topics(claims, spark.createDataFrame([("error",), ("no such topic",)], "slug string")).select("event_id", F.col("slug").alias("event_type"))


@query(
    "curation_survivors",
    """with c as (select c_custkey as slug, c_nationkey as n, [c_mktsegment, c_name] as s, c_acctbal > 0 as d from customer where c_custkey not in (select s_suppkey from supplier)), l as (select n, max(c_custkey) as last from (select c_custkey, c_nationkey as n from customer) group by n),
    m as (select case when slug = last then slug else last end as "into", slug <> last as o, slug, n, s, d from c join l using (n))
    select "into" as slug, sum(n)::bigint as n, array_to_string(flatten(list(s order by o, slug))[1:3], '|') as samples, bool_or(d) as on_disk from m group by 1""",
)
def curation_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation merge into its last; suppliers' numbers are dropped."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_nationkey").cast("bigint").alias("n"), F.array("c_mktsegment", "c_name").alias("samples"), (F.col("c_acctbal") > 0).alias("on_disk"))
    last = c.groupBy("n").agg(F.max("slug").alias("new"))
    merges = c.select(F.col("slug").alias("old"), "n").join(last, "n").where("old <> new").select("old", "new")
    drops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug"))
    out = C.survivors(c, merges, drops, spark.createDataFrame([], "slug bigint"))
    return out.select("slug", "n", F.array_join("samples", "|").alias("samples"), "on_disk")


@query("curation_denials", "select o_orderkey as \"from\", o_custkey as \"into\" from orders where o_orderstatus <> 'F'")
def curation_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders proposed for their customers; finished ones are confirmed, open ones denied, pending ones not judged."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 10**9).alias("k"), "o_orderkey", "o_custkey", "o_orderstatus")
    judged = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("from"), F.col("k").alias("into"), F.when(F.col("o_orderstatus") == "F", "confirm").otherwise("deny").alias("verdict"))
    return C.denials(o.select(F.col("k").alias("from"), F.col("o_custkey").alias("into")), judged).select((F.col("from") - 10**9).alias("from"), "into")


@query("curation_open", "select o_orderkey as slug from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderkey not in (select l_suppkey from lineitem where l_returnflag = 'R') and o_orderkey not in (select c_nationkey from customer)")
def curation_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are candidates: those with lines returned are in pairs with suppliers, nations' numbers in clusters."""
    pairs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("from"), F.col("l_suppkey").alias("into"))
    clusters = table(spark, sf_dir, "customer").select(F.array(F.col("c_nationkey").cast("bigint")).alias("members"))
    return C.open_candidates(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug")), pairs, clusters)


@query(
    "curation_present",
    """with s as (select c_custkey as slug from customer), cl as (select l_orderkey as o, max(l_partkey) as m from lineitem group by 1)
    select 'pair' as what, o_orderkey as id from orders where o_custkey in (select slug from s) and o_orderkey in (select slug from s) union all select 'cluster', o from cl where m in (select slug from s)""",
)
def curation_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers are candidates, without gaps: pairs of order and customer, clusters of an order's parts."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"))
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("from"), F.col("o_custkey").alias("into"))
    clusters = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("members"))
    return C.still_present(pairs, known).select(F.lit("pair").alias("what"), F.col("from").alias("id")).union(C.clusters_present(clusters, known).select(F.lit("cluster"), "l_orderkey"))


@query(
    "curation_records",
    """with m as (select c_custkey as k, c_nationkey as n, c_acctbal as b from customer) select 'merge' as action, 'c-' || k as "from", 'n-' || n as "into", case when b > 0 then 'alias' else 'model' end as signal, null::int as class from m
    union all select 'drop', 's-' || s_suppkey, null, 'model', null from supplier union all select 'cluster', 'p-' || p_size || ' ' || 'p-x', 'p-' || p_partkey, 'region-form', 5 from part""",
)
def curation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts lead clusters, in names of their own until the records are made: a size is a member even where it is the part's number too."""
    c = table(spark, sf_dir, "customer").select(say("c-", F.col("c_custkey")).alias("old"), say("n-", F.col("c_nationkey")).alias("new"), "c_acctbal")
    pairs = c.where("c_acctbal > 0").select(F.col("old").alias("from"), F.col("new").alias("into"), F.lit("alias").alias("signal"))
    lead = say("part-", F.col("p_partkey"))
    clusters = table(spark, sf_dir, "part").select(F.array(F.lit("p-x"), lead, say("p-", F.col("p_size"), "")).alias("members"), lead.alias("into"), F.lit("region-form").alias("signal"), F.lit(5).alias("class"))
    r = C.decision_records(c.select("old", "new"), pairs, "entities", "run", "2024", table(spark, sf_dir, "supplier").select(say("s-", F.col("s_suppkey")).alias("slug")), clusters)
    return r.select("action", F.array_join("from", " ").alias("from"), F.regexp_replace("into", "^part-", "p-").alias("into"), "signal", "class")


_GONE = "with p as (select p_type || '/' || p_brand || '/' || p_partkey || '.md' as path, p_partkey as slug, p_type, p_brand from part), g as (select * from p where slug in (select c_custkey from customer where c_acctbal > 0) or slug in (select l_suppkey from lineitem))"


def _deleted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand", say(F.col("p_partkey"), ".md")).alias("path"), F.col("p_partkey").alias("slug"))
    merges = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("old"))
    return pages, C.deletions(pages, merges, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("slug")), spark.createDataFrame([], "slug bigint, `into` bigint"))


@query("curation_deletions", f"{_GONE} select path from g")
def curation_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[1].select("path")


@query("curation_emptied_folders", f"{_GONE}, f as (select path, p_type as folder from p union all select path, p_type || '/' || p_brand from p), h as (select path, p_type as folder from g union all select path, p_type || '/' || p_brand from g) select distinct folder from h where folder not in (select folder from f where path not in (select path from g))")
def curation_emptied_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.emptied_folders(*_deleted(spark, sf_dir))


# ---- state

_LEDGERS = "select d.doc_id as path, case when source = 'src2' or lang = 'fr' then 'write' when lang = 'en' then 'conflict' when lang = 'de' then 'converge' else 'write' end as verdict from documents d"


@query("state_write_verdicts", _LEDGERS)
def state_write_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On disk are pages but French ones, English ones edited since, German ones as rendered now; one source has no record."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang", "source", F.sha2("text", 256).alias("hash"))
    is_ = lambda x: F.col("lang") == x
    disk = d.where("lang <> 'fr'").select("path", F.when(is_("en"), "edited").when(is_("de"), F.col("hash")).otherwise("old").alias("hash"))
    return state.write_verdicts(d.select("path", "hash"), disk, d.where("source <> 'src2'").select("path", F.lit("old").alias("hash")))


@query("state_decisions", "select c_custkey as id, 'ledger' as \"by\" from customer union all select s_suppkey + 1000000000, 'new' from supplier where s_suppkey not in (select c_custkey from customer where c_nationkey = 0)")
def state_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New records of all suppliers, of which customers of one nation's number are in the ledger already."""
    rec = lambda df, k, into, at: df.select(F.lit("e").alias("concern"), F.lit("merge").alias("action"), F.array(text(k), F.lit("x")).alias("from"), into.alias("into"), F.lit("model").alias("signal"), F.lit(at).alias("decidedAt"), F.col(k).alias("id"))
    ledger = rec(table(spark, sf_dir, "customer"), "c_custkey", F.when(F.col("c_nationkey") == 0, "n").otherwise("other"), "1")
    new = rec(table(spark, sf_dir, "supplier"), "s_suppkey", F.lit("n"), "2").withColumn("from", F.reverse("from"))
    out, _ = state.append_decisions(ledger, new, spark.createDataFrame([], "slug string"))
    by = F.when(F.col("decidedAt") == "2", "new").otherwise("ledger")
    return out.select((F.col("id") + F.when(by == "new", 10**9).otherwise(0)).alias("id"), by.alias("by"))


@query("state_records", "select o_custkey as path, max(o_orderdate)::varchar as at, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as k from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0) group by 1 union all select s_suppkey + 1000000000, 'new', s_nationkey from supplier")
def state_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer whose page is there, and new records of suppliers."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("k"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("d"), F.col("o_orderkey").alias("o")).alias("synthesizedAt"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10**9).alias("path"), F.col("s_nationkey").cast("bigint").alias("k"), F.struct(F.lit("new").alias("d"), F.lit(0).cast("bigint").alias("o")).alias("synthesizedAt"))
    up = state.upsert(old, new, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path")))
    return up.select("path", F.col("synthesizedAt.d").alias("at"), "k")


@query("state_changes", "select 'folder' as type, c_mktsegment || c_nationkey as path, count(*)::bigint as n from customer group by all union all select 'type', s_nationkey::varchar, count(*) from supplier group by all")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log has the customers' changes; of new ones only those of suppliers are new."""
    c = table(spark, sf_dir, "customer").select(F.lit("folder").alias("type"), F.concat("c_mktsegment", text("c_nationkey")).alias("path"))
    new = c.distinct().union(table(spark, sf_dir, "supplier").select(F.lit("type"), text("s_nationkey")))
    return state.append_changes(c, new).groupBy("type", "path").agg(F.count(F.lit(1)).alias("n"))


@query("state_known_types", "select string_agg(distinct t, '|' order by t) as types from (select p_type as t from part union select c_mktsegment from customer)")
def state_known_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = state.known_types(table(spark, sf_dir, "part").select(F.col("p_type").alias("type")), table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("type")))
    return k.select(F.array_join("types", "|").alias("types"))


@query("state_usage", "select count(*)::bigint as calls, sum(user_id)::bigint as input, sum(event_id)::bigint as output, round(sum(value), 4) as cost from events where strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-10T12:00:00'")
def state_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("user_id").alias("inputTokens"), F.col("event_id").alias("outputTokens"), F.col("value").alias("cost"))
    u = state.usage_since(log, "2024-01-10T12:00:00")
    return u.select("calls", F.col("inputTokens").alias("input"), F.col("outputTokens").alias("output"), F.round("cost", 4).alias("cost"))


@query("state_retry_alarm", "select user_id, count(*)::bigint as calls, count(*) filter (event_type = 'error')::bigint as repairs, count(*) filter (event_type = 'error') >= 5 or count(*) filter (event_type = 'error') / count(*) > 0.25 as alarm from events group by 1")
def state_retry_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("event_type") == "error", 1)).alias("repairs"))
    return g.withColumn("alarm", state.retry_alarm(F.col("calls"), F.col("repairs")))


def _memory(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_type").alias("folder"))
    return state.rolling_memory(e, table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("slug")))


@query("state_memory", "select p_partkey as slug, p_type as folder, count(l_partkey)::bigint as \"mentionCount\" from part left join lineitem on l_partkey = p_partkey and l_returnflag = 'R' group by all")
def state_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir, "R")


_CHANGED = """with b as (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1), a as (select p_partkey as k, p_type as folder, (select count(*) from lineitem where l_partkey = p_partkey and l_returnflag = 'A') as n from part),
  ch as (select a.k, p_name as title, folder, (a.n - coalesce(b.n, 0))::bigint as added, case when b.n is null then 'new' when a.n > b.n and a.k not in (select s_suppkey from supplier) then 'updated' end as status from a join part on p_partkey = a.k left join b on b.k = a.k)"""


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _memory(spark, sf_dir, "R").where("mentionCount > 0")
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"))
    return state.entity_changes(before, _memory(spark, sf_dir, "A"), titles, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug")))


@query("state_entity_changes", f"{_CHANGED} select k as slug, title, folder, added, status from ch where status is not null")
def state_entity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines returned are the mentions of the run before, lines accepted those of this one."""
    return _changed(spark, sf_dir)


@query("state_page_types", "select p_type as type, count(*)::bigint as n from part group by 1")
def state_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.page_types(table(spark, sf_dir, "part").select(F.col("p_type").alias("type")))


@query("state_written_types", "select case when p_size > 25 then 'topic' else 'entity' end as type, count(*)::bigint as n from part group by 1 union all select 'document', 7")
def state_written_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("p_size") > 25, "topics").when(F.col("p_size") > 10, "comparisons").otherwise("entities")
    return state.written_by_type(table(spark, sf_dir, "part").select(F.concat_ws("/", folder, "p_name").alias("path")), 7)


@query(
    "state_run_metrics",
    f"""{_CHANGED}, ev as (select event_type as t, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, user_id as i, event_id as o, value as v from events)
    select (select count(*) filter (status = 'new') from ch)::bigint as new_entities, (select count(*) filter (status = 'updated') from ch)::bigint as updated_entities, (select sum(i + o) from ev)::bigint as tokens, (select count(*) filter (t = 'error') from ev)::bigint as manual, (select count(*) filter (t <> 'error') from ev)::bigint as preservation,
    (select count(*) from (select distinct p_brand from part))::bigint as folders, (select count(*) from part where p_size <= 25)::bigint as entity_pages, 0 as failed, (select count(*) from orders where o_orderstatus = 'F')::bigint as new_pdfs, (select coalesce(sum(o_custkey), 0) from orders where o_orderstatus = 'P')::bigint as skipped""",
)
def state_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("user_id").alias("inputTokens"), F.col("event_id").alias("outputTokens"), F.col("value").alias("cost"), F.when(F.col("event_type") == "error", "manual-edit").alias("type"))
    part = table(spark, sf_dir, "part")
    status = F.when(F.col("o_orderstatus") == "F", "new").when(F.col("o_orderstatus") == "P", "unchanged").otherwise("changed")
    ledger = table(spark, sf_dir, "orders").select(status.alias("status"), F.col("o_custkey").alias("chunks"))
    none = spark.createDataFrame([], "folder string")
    written = state.written_by_type(part.select(F.when(F.col("p_size") > 25, "topics/x").otherwise("entities/x").alias("path")), 0)
    counters = spark.createDataFrame([], "relationships bigint, claims bigint, claimsByType map<string,bigint>")
    m = state.full_metrics("run", _changed(spark, sf_dir), counters, written, state.usage_since(ev, "2024"), state.conflict_counts(ev, "2024"), ledger, none, part.select(F.col("p_brand").alias("folder")).distinct(), spark.createDataFrame([], "`check` string, n bigint"))
    return m.select(F.col("entitiesNew").alias("new_entities"), F.col("entitiesUpdated").alias("updated_entities"), F.col("totalTokens").alias("tokens"), F.col("conflictsManualEdit").alias("manual"), F.col("conflictsPreservation").alias("preservation"), F.col("foldersCreated").alias("folders"), F.col("pagesByType")["entity"].alias("entity_pages"), F.col("chunksFailed").alias("failed"), F.col("newPdfs").alias("new_pdfs"), F.col("chunksSkipped").alias("skipped"))


@query("state_summary", "select count(*) filter (o_orderstatus = 'F') || ' strict, ' || count(*) filter (o_orderstatus = 'O') || ' permissive, ' || count(*) filter (o_orderstatus = 'P') || ' conflicts, ' || sum(o_custkey) || ' issues' as summary from orders")
def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("o_orderstatus") == "F", "strict").when(F.col("o_orderstatus") == "O", "permissive").otherwise("conflict")
    return state.ingest_summary(table(spark, sf_dir, "orders").select(mode.alias("finalMode"), F.col("o_custkey").alias("issues")))


@query("ingest_stale", "select l_orderkey as source, count(*)::bigint as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1")
def ingest_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"))
    return ingest.drop_stale(chunks, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_to_process", "select doc_id from documents where lang in ('fr', 'de')")
def ingest_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger knows no French documents and other German ones."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), F.sha2("text", 256).alias("hash"), "lang")
    ledger = d.where("lang <> 'fr'").select("slug", F.when(F.col("lang") == "de", "old").otherwise(F.col("hash")).alias("hash"))
    return ingest.to_process(d, ledger).select(F.col("slug").alias("doc_id"))


# ---- rendering and reading of pages


@query(
    "render_document_pages",
    "select doc_id, '---' || chr(10) || 'title: doc-' || doc_id || chr(10) || 'type: document' || chr(10) || 'updated: 2024' || chr(10) || 'sources: ' || chr(10) || '  - file: ' || source || chr(10) || '    pages: 1-5' || chr(10) || '    sha256: ' || sha256(text) || chr(10) || '---' || chr(10) || chr(10) || text as page from documents",
)
def render_document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", say("doc-", F.col("doc_id")).alias("chunk_id"), F.col("source").alias("file"), F.lit("1-5").alias("pages"), F.sha2("text", 256).alias("sha256"), F.lit("2024").alias("updated"), F.col("text").alias("body"))
    return d.select("doc_id", "chunk_id").join(render.document_pages(d), "chunk_id").select("doc_id", "page")


@query(
    "render_source_pages",
    """with w as (select source, string_agg('- [[doc-' || doc_id || ']]', chr(10) order by doc_id) as l, count(*)::bigint as n, string_agg(case when n_chars < 300 then '- short ' || doc_id end, chr(10) order by doc_id) as w from documents group by source)
    select source, '# ' || source || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| File | ' || source || ' |' || chr(10) || '| SHA-256 | x |' || chr(10) || '| Pages | ' || n || ' |' || chr(10) || chr(10) || '## Document pages' || chr(10) || chr(10) || l || coalesce(chr(10) || chr(10) || '## Warnings' || chr(10) || chr(10) || w, '') as body from w""",
)
def render_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    s = d.groupBy("source").agg(F.count(F.lit(1)).alias("page_count")).select("source", F.col("source").alias("file"), F.lit("x").alias("sha256"), "page_count")
    warn = d.where("n_chars < 300").select("source", F.col("doc_id").alias("page_no"), say("short ", F.col("doc_id")).alias("warning"))
    return render.source_pages(s, d.select("source", say("doc-", F.col("doc_id")).alias("chunk_id"), F.col("doc_id").alias("chunk_ord")), warn)


_TREE = "with p as (select 'w/' || p_type || '/' || p_brand || '/' || p_partkey || '.md' as path, p_type as t, p_brand as b, p_partkey as k, p_name as title from part)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("w"), "p_type", "p_brand", say(F.col("p_partkey"), ".md")).alias("path"), F.col("p_name").alias("title"))


@query(
    "render_folder_index",
    f"""{_TREE}, x as (select 'w/' || t || '/' || b as folder, b as name, count(*) as pages, count(*) as direct, 0 as subs, string_agg('- [[' || left(path, length(path) - 3) || '|' || title || ']]', chr(10) order by path, '- [[' || left(path, length(path) - 3) || '|' || title || ']]') as cat, null as sub from p group by t, b
    union all select 'w/' || t, t, count(*), 0, count(distinct b), null, string_agg(distinct '- [[w/' || t || '/' || b || '/index|' || b || ']]', chr(10) order by '- [[w/' || t || '/' || b || '/index|' || b || ']]') from p group by t
    union all select 'w', 'w', count(*), 0, count(distinct t), null, string_agg(distinct '- [[w/' || t || '/index|' || t || ']]', chr(10) order by '- [[w/' || t || '/index|' || t || ']]') from p union all select '', 'index', count(*), 0, 1, null, '- [[w/index|w]]' from p)
  select folder, '# ' || case when name = 'w' then 'W' else name end || chr(10) || chr(10) || '## Statistics' || chr(10) || chr(10) || pages || ' pages, ' || direct || ' here, ' || subs || ' sub-folders' || coalesce(chr(10) || chr(10) || '## Folders' || chr(10) || chr(10) || sub, '') || coalesce(chr(10) || chr(10) || '## Catalog' || chr(10) || chr(10) || cat, '') as body from x""",
)
def render_folder_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tree(spark, sf_dir)
    return render.folder_index(p, render.folder_stats(p.select("path")))


@query("render_write_order", f"{_TREE} select distinct 'w/' || t || '/' || b as folder, 3 as level from p union all select distinct 'w/' || t, 2 from p union all select 'w', 1 union all select '', 0")
def render_write_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.write_order(render.folder_stats(_tree(spark, sf_dir).select("path")))


@query("render_workspace", "select c_mktsegment as wiki, '- [[' || c_mktsegment || '/index]] — ' || count(*) filter (c_nationkey < 5) || ' sources, ' || count(*) filter (c_nationkey between 5 and 9) || ' documents, ' || count(*) filter (c_nationkey between 10 and 14) || ' entities, ' || count(*) filter (c_nationkey > 14) || ' topics' as line from customer where c_mktsegment <> 'MACHINERY' group by 1")
def render_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are wikis, one of them without a root index; nations choose the section."""
    n = F.col("c_nationkey")
    section = F.when(n < 5, "sources").when(n < 10, "documents").when(n < 15, "entities").otherwise("topics")
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("wiki"), F.concat_ws("/", section, "c_name").alias("path"))
    roots = c.where("wiki <> 'MACHINERY'").select("wiki", F.lit("index.md").alias("path")).distinct()
    return render.workspace_lines(render.workspace_counts(c.union(roots)), spark.createDataFrame([], "wiki string, line string"), "none")


@query("render_structural_changes", f"{_TREE} select 'new-folder' as type, t || '/' || b as path, string_agg(k::varchar, ' ' order by k::varchar) as affected from p where t <> 'ECONOMY' group by t, b union all select 'new-type', t, string_agg(k::varchar, ' ' order by k::varchar) from p where t <> 'ECONOMY' group by t")
def render_structural_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("folder"), F.col("p_type").alias("type"), text("p_partkey").alias("slug"), F.lit("x").alias("path"))
    had = p.where("type = 'ECONOMY'")
    f = render.structural_changes(had.select("folder").distinct(), p.select("folder").distinct(), p, "now").unionByName(render.type_changes(had, p, "now"))
    return f.select("type", "path", F.array_join("affected", " ").alias("affected"))


_FRONT = "with c as (select c_custkey as k, c_name as n, c_mktsegment as m, c_acctbal > 0 as s from customer)"


def _front(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    head = say("---\ntitle: \"", F.col("c_name"), "\"\ntype: entity\naliases: [", F.col("c_mktsegment"), ", b]\nsources:\n  - file: ", F.lower("c_mktsegment"), ".pdf\n    pages: 1-3\nsparse: ", F.when(F.col("c_acctbal") > 0, "true").otherwise("false"), "\n---\n# ", F.col("c_name"), "\n\n## Facts\n- nation ", F.col("c_nationkey"), "\n- second\n\n## Other\n- no\n")
    return c.select(say("entities/", F.col("c_custkey"), ".md").alias("path"), head.alias("page"))


@query("read_frontmatter", f"{_FRONT} select 'entities/' || k || '.md' as path, n as title, 'entity' as type, m || ' b' as aliases, lower(m) || '.pdf' as file, '1-3' as pages, s as sparse from c")
def read_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = readers.frontmatter(_front(spark, sf_dir))
    return f.select("path", "title", "type", F.array_join("aliases", " ").alias("aliases"), F.col("sources")[0]["file"].alias("file"), F.col("sources")[0]["pages"].alias("pages"), "sparse")


@query("read_section_bullets", "select 'entities/' || c_custkey || '.md' as path, 'nation ' || c_nationkey as bullet from customer union all select 'entities/' || c_custkey || '.md', 'second' from customer")
def read_section_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.section_bullets(readers.split_frontmatter(_front(spark, sf_dir)), "Facts").select("path", "bullet")


@query("read_section_pages", f"{_TREE} select k::varchar as slug, path as locations from p")
def read_section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.section_pages(_tree(spark, sf_dir), "w").select("slug", F.array_join("locations", " ").alias("locations"))


@query("read_folder_tree", f"{_TREE} select 'w/' || t || '/' || b as folder, count(*)::int as files, 0 as subfolders from p group by t, b union all select 'w/' || t, 0, count(distinct b)::int from p group by t union all select 'w', 0, count(distinct t)::int from p union all select '', 0, 1")
def read_folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    return readers.folder_tree(_tree(spark, sf_dir)).select("folder", size("files"), size("subfolders"))


@query("read_call_log", "select event_type as model, count(*)::bigint as calls, sum(user_id)::bigint as tokens from events group by 1")
def read_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as a log of calls, a torn line in each file, and read again."""
    import uuid

    from folioforge.plans.lineage import shared_dir, to_delete

    path = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    to_delete(spark, path)
    ev = table(spark, sf_dir, "events").select(F.to_json(F.struct(text("ts").alias("timestamp"), F.col("event_type").alias("model"), F.col("user_id").alias("inputTokens"))).alias("value"))
    ev.unionByName(spark.range(3).select(F.lit('{"timestamp": "2024", "mod').alias("value"))).write.text(path)
    return readers.call_log(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("inputTokens").alias("tokens"))


@query("read_page_counts", "select conv_id as file, max(turn) as page_count from conversations group by 1")
def read_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_counts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page_no")))


@query("render_line_diff", "select doc_id, '-a ' || doc_id || chr(10) || '+b ' || doc_id || chr(10) || ' c' || chr(10) || ' d' || chr(10) || '...' || chr(10) || ' f' || chr(10) || ' g' || chr(10) || '+' || lang as diff from documents")
def render_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", diff_column(say("a ", k, "\nc\nd\ne\nf\ng"), say("b ", k, "\nc\nd\ne\nf\ng\n", F.col("lang"))).alias("diff"))


# ---- scalar functions, several to a query


@query(
    "functions_of_links",
    """select p_partkey, replace(p_name, ' ', '-') as target, case when p_size > 25 then p_brand end as display, case when p_size > 25 then '[[' || replace(p_name, ' ', '-') || '|' || p_brand || ']]' else '[[' || replace(p_name, ' ', '-') || ']]' end as link, 'x ' || p_brand as bare, 'at ' || p_name as context,
    case when lower(p_name) = lower(p_type) then '' else p_name end as alias, p_name || '|' || p_type as aliases, '[[new|' || p_name || ']] and [[y]]' as rewritten, case when length(p_brand) > 7 then '"' || p_brand || '"' else '"' || p_brand || '"' end as yaml from part""",
)
def functions_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    inner = F.concat(F.lit(" "), slug, F.when(F.col("p_size") > 25, F.concat(F.lit(" | "), "p_brand", F.lit(" "))).otherwise(F.lit(" ")))
    p = table(spark, sf_dir, "part").select("*", inner.alias("inner"), slug.alias("slug"))
    body = F.concat(F.lit("[["), "slug", F.lit("]] and [[y]]"))
    return p.select(
        "p_partkey", T.wikilink_target("inner").alias("target"), T.wikilink_display("inner").alias("display"), T.format_wikilink("slug", T.wikilink_display("inner")).alias("link"),
        T.strip_citations(F.concat(F.lit(" x[^src1] "), "p_brand", F.lit("[^src22]"))).alias("bare"), T.mention_context(say('Page 3: "at ', F.col("p_name"), '" [^src3]')).alias("context"),
        F.array_join(T.alias_of("p_name", "p_type"), "|").alias("alias"), F.array_join(T.combined_aliases("p_name", "p_brand", F.array(F.upper("p_name"), F.lit("  "), F.col("p_type"), F.lower("p_brand"))), "|").alias("aliases"),
        T.rewrite_links(body, F.create_map("slug", F.lit("new")), F.create_map("slug", "p_name")).alias("rewritten"), T.yaml_string("p_brand").alias("yaml"),
    )


@query(
    "functions_of_names",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'doc-' || l_orderkey as source, false as upper_slug, true as slug, sha256(l_orderkey::varchar) as sha, l_linenumber as low, l_linenumber + l_suppkey::int as high, 'f' || l_partkey || '.pdf' as file, 'f.md' as base, 'a/b' || l_suppkey as folder,
    least('k' || l_partkey, 'k' || l_suppkey) || ' ' || greatest('k' || l_partkey, 'k' || l_suppkey) as pair, (5000 * pow(3, l_linenumber - 1))::bigint as backoff, l_suppkey + 400 = 429 or l_suppkey + 400 >= 500 as transient, 'path ' || l_partkey as path, 'Hi ' || l_suppkey || '!' as filled,
    case when l_linenumber > 3 then 'x-' || l_partkey else null end as indicator, case when left(l_partkey::varchar, 1) = left(l_suppkey::varchar, 1) then 1 else 0 end as prefix from lineitem""",
)
def functions_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, a, b = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    r = T.page_range(say(" ", n, " - ", n + b))
    same = T.common_prefix_length(F.substring(text("l_partkey"), 1, 1), F.substring(text("l_suppkey"), 1, 1))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.chunk_source(say("doc-", F.col("l_orderkey"), "-part-001")).alias("source"), T.is_slug(say("A", a)).alias("upper_slug"), T.is_slug(say("a-", a)).alias("slug"), T.sha256(text("l_orderkey")).alias("sha"),
        r["min"].alias("low"), r["max"].alias("high"), T.citation_file(say(" f", a, ".pdf, pages 1, 2")).alias("file"), T.base_name(say("a/b", b, "/f.md")).alias("base"), T.folder_of(say("a/b", b, "/f.md")).alias("folder"), F.array_join(T.pair_key(say("k", a), say("k", b)), " ").alias("pair"),
        T.backoff_ms(n).alias("backoff"), T.is_transient(say("HTTP ", b + 400, " answered")).alias("transient"), T.clean_path(say(" '\"path ", a, "\"' ")).alias("path"), T.fill_template("Hi {{who}}!", {"who": text("l_suppkey")}).alias("filled"), T.indicator(F.when(n > 3, say("indikator-", n, "-x-", a)).otherwise(say("other-", n)))["name"].alias("indicator"), same.alias("prefix"),
    )


@query("functions_of_slugs", "select p_partkey, length(p_name) + 64 as tokens, replace(replace(replace(p_name, 'ae', 'a'), 'oe', 'o'), 'aa', 'a') as canonical, p_name like '%ae%' or p_name like '%oe%' or p_name like '%aa%' as digraph, true as in_order, false as not_in_order, sha256('{\"a\":' || p_size || ',\"b\":\"' || p_name || '\"}') as fingerprint, 'inner ' || p_name as fence from part")
def functions_of_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").alias("a"), F.col("p_name").alias("b"), F.lit(None).cast("string").alias("c"))
    return p.select("p_partkey", T.decision_tokens("p_name").alias("tokens"), T.transliteration_canonical("p_name", "da").alias("canonical"), T.carries_digraph("p_name", "da").alias("digraph"), T.letters_in_order(F.regexp_replace("p_name", "[aeiou]", ""), "p_name").alias("in_order"), T.letters_in_order(F.concat("p_name", F.lit("x")), "p_name").alias("not_in_order"), T.fingerprint("b", "c", "a").alias("fingerprint"), T.strip_fences(say("```md\ninner ", F.col("p_name"), "\n```\nrest")).alias("fence"))
