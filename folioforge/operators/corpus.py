"""Queries over a corpus of extraction records made of the tables.

An order is a chunk and a line of it an item: lines returned are observations of entities (the part), lines accepted are
relationships from part to supplier, the others claims about both. Each line counts, and repeated ones are items of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import aggregate as A
from folioforge.operators import curate, extract, ingest, preserve, render
from folioforge.operators.registry import query
from folioforge.sources.tables import table

_PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate"]


def _slug(c: str):
    return F.concat(F.lit("e-"), F.col(c).cast("string"))


def _items(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    a, b = _slug("l_partkey"), _slug("l_suppkey")
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return li.select(
        F.col("l_orderkey").alias("chunk_ord"), F.struct(*_PLACE).alias("pos"), a.alias("a"), b.alias("b"), F.col("l_linestatus").alias("t"), F.col("l_linenumber").alias("page"),
        F.concat(F.lit("raw/f"), F.col("l_suppkey").cast("string"), F.lit(".pdf")).alias("file"), F.col("l_linenumber").cast("string").alias("pages"), F.col("l_quantity").cast("bigint").cast("string").alias("q"),
    )


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir, "R")
    return i.select(F.col("a").alias("slug"), F.concat(F.lit("Part "), "a").alias("name"), F.col("t").alias("type"), F.concat(F.lit("entities/"), F.lower("t")).alias("folder"), F.concat(F.lit("of "), "q").alias("significance"), "chunk_ord", "pos", "page", "file", "pages", F.concat(F.lit("order "), F.col("chunk_ord").cast("string")).alias("context"))


def _rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "A").select(F.col("a").alias("subject"), F.lit("supplied-by").alias("predicate"), F.col("b").alias("object"), F.concat(F.lit("ev "), "q").alias("evidence"), "page", "file", "pages", "chunk_ord", "pos")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "N").select(F.concat(F.lit("sold "), "q").alias("text"), F.concat(F.lit("topic-"), F.substring("b", 3, 99)).alias("type"), F.array("a", "b").alias("entities"), "page", "file", "pages", "chunk_ord", "pos")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = table(spark, sf_dir, "supplier").select(_slug("s_suppkey").alias("slug"), F.concat(F.lit("entities/n"), F.col("s_nationkey").cast("string")).alias("folder"))
    return A.entities(_obs(spark, sf_dir), memory)


_BASE = """with li as (select l_orderkey as o, row(l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus, l_shipdate) as p, l_returnflag as k, 'e-' || l_partkey as a, 'e-' || l_suppkey as b, l_linestatus as t, l_linenumber as page,
    'raw/f' || l_suppkey || '.pdf' as file, l_linenumber::varchar as pages, l_quantity::bigint::varchar as q, l_suppkey as s from lineitem),
  known as (select a as slug, 'Part ' || a as name, arg_min(t, row(o, p)) as type, arg_min('entities/' || lower(t), row(o, p)) as folder, arg_min('of ' || q, row(o, p)) as significance, min(o) as first, count(*)::bigint as n_obs from li where k = 'R' group by a),
  mem as (select 'e-' || s_suppkey as slug, 'entities/n' || s_nationkey as folder from supplier),
  ment as (select distinct a as slug, page, 'order ' || o as context, file, pages, o, min(p) over (partition by a, page, o, file) as p from li where k = 'R'),
  rel as (select a as slug, b as object, page, file, pages, arg_min('ev ' || q, row(o, p)) as evidence, min(row(o, p)) as pt from li join known on slug = a and first <= o where k = 'A' group by a, b, page, file, pages),
  inc as (select b as slug, a as subject, page, file, pages, arg_min('ev ' || q, row(o, p)) as evidence, min(row(o, p)) as pt from li join known on slug = b and first <= o where k = 'A' and a <> b group by a, b, page, file, pages),
  cl as (select o, p, 'sold ' || q as text, 'topic-' || s as type, a, b, page, file, pages from li where k = 'N'),
  att as (select slug, text, c.type as type, page, file, pages, a, b, min(row(o, p)) as pt from (select *, unnest([a, b]) as e from cl) c join known on slug = e and first <= o group by all)"""


@query("wiki_entities", f"{_BASE} select slug, name, type, coalesce(mem.folder, known.folder) as folder, significance, n_obs from known left join mem using (slug)")
def wiki_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).drop("first_at")


@query("wiki_relationships", f"{_BASE} select slug, 'supplied-by' as predicate, object, page, file, evidence, struct_extract_at(pt, 1) as chunk_ord from rel")
def wiki_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parts observed by then; of repeated ones the first evidence stays."""
    return A.dedupe(A.outgoing(_rels(spark, sf_dir), _known(spark, sf_dir)), "relationships").select("slug", "predicate", "object", "page", "file", "evidence", "chunk_ord")


@query("wiki_incoming", f"{_BASE} select slug, subject, page, file, evidence, struct_extract_at(pt, 1) as chunk_ord from inc")
def wiki_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, rels = _known(spark, sf_dir), _rels(spark, sf_dir)
    inc, out = A.dedupe(A.incoming(rels, known), "incoming"), A.dedupe(A.outgoing(rels, known), "relationships")
    return A.without_own_edges(inc, out).select("slug", "subject", "page", "file", "evidence", "chunk_ord")


@query("wiki_claims", f"{_BASE} select slug, text, type, page, file, a || ' ' || b as entities, struct_extract_at(pt, 1) as chunk_ord from att")
def wiki_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.dedupe(A.mentions_of(_claims(spark, sf_dir), _known(spark, sf_dir)), "claims")
    return c.select("slug", "text", "type", "page", "file", F.array_join("entities", " ").alias("entities"), "chunk_ord")


@query(
    "wiki_timeline",
    f"""{_BASE} select slug, strftime(ts, '%Y-%m-%d') as date, event_type as event, min(event_id) as chunk_ord from events join known on slug = 'e-' || user_id and first <= event_id group by all""",
)
def wiki_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users that have a part's number."""
    ev = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("event"), F.array(_slug("user_id")).alias("entities"), F.col("event_id").alias("chunk_ord"), F.col("event_id").alias("pos"))
    return A.dedupe(A.mentions_of(ev, _known(spark, sf_dir)), "timeline").select("slug", "date", "event", "chunk_ord")


@query(
    "wiki_contexts",
    f"{_BASE} select a as slug, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as contexts from li join orders on o_orderkey = o where k = 'R' and trim(o_orderpriority) <> '' group by a",
)
def wiki_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts stay in their chunk: an order's priority goes to the parts observed in it."""
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("context"))
    obs = _obs(spark, sf_dir).select(F.col("chunk_ord").alias("chunk_id"), "slug")
    return A.contexts(records, obs).select("slug", F.array_join("contexts", "|").alias("contexts"))


@query("wiki_topics", f"{_BASE} select type as slug, 'Topic ' || s as title, count(*)::bigint as n, arg_min(text, row(o, p)) as first_text from (select *, type[7:] as s from cl) group by all")
def wiki_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topics(_claims(spark, sf_dir)).select("slug", "title", F.size("claims").cast("bigint").alias("n"), F.col("claims")[0]["text"].alias("first_text"))


@query(
    "wiki_topic_titles",
    f"{_BASE} select c.type as slug, string_agg(distinct coalesce(name, e), '|' order by coalesce(name, e)) as titles from (select type, unnest([a, b]) as e from cl) c left join known on slug = e group by c.type",
)
def wiki_topic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _known(spark, sf_dir).select("slug", F.col("name").alias("title"))
    return A.topic_titles(_claims(spark, sf_dir), titles).select("slug", F.array_join("titles", "|").alias("titles"))


_TABLES = """, tb as (select 'e-' || (p_size * 40 - p_partkey) as subject, p_type || ' ' || p_brand as title, p_size as page, '| ' || p_name || ' |' as markdown, 'e-' || p_partkey as e, 'raw/' || p_brand as file, p_partkey as o from part),
  kt as (select *, case when slug is not null then subject else trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') end as key from tb left join known on slug = subject),
  once as (select key, file, page, title, markdown, min(o) as o from kt group by all),
  ke as (select distinct key, e from once join kt using (key, file, page, title, markdown, o))"""


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a table about the part of another number, or, where there is none, about its own title."""
    text = lambda c: F.col(c).cast("string")
    t = table(spark, sf_dir, "part").select(
        F.concat(F.lit("e-"), (F.col("p_size") * 40 - F.col("p_partkey")).cast("string")).alias("subject"), F.concat_ws(" ", "p_type", "p_brand").alias("title"), F.col("p_size").alias("page"), F.concat(F.lit("| "), "p_name", F.lit(" |")).alias("markdown"),
        F.array(F.concat(F.lit("e-"), text("p_partkey"))).alias("entities"), F.concat(F.lit("raw/"), "p_brand").alias("file"), F.lit("1").alias("pages"), F.col("p_partkey").alias("chunk_ord"), F.lit(0).alias("pos"),
    )
    return A.comparisons(t, _known(spark, sf_dir))


@query(
    "wiki_comparisons",
    f"""{_BASE}{_TABLES} select key, s.sections, x.entities, s.captions from (select key, string_agg(file || ':' || page || ':' || title || ':' || markdown, ';' order by file, page, title, markdown) as sections, string_agg(distinct title, ';' order by title) as captions from once group by key) s
    join (select key, string_agg(e, ' ' order by e) as entities from ke group by key) x using (key)""",
)
def wiki_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comparisons(spark, sf_dir)
    one = F.transform("sections", lambda s: F.concat_ws(":", s["file"], s["page"].cast("string"), s["title"], s["markdown"]))
    return c.select("key", F.array_join(one, ";").alias("sections"), F.array_join("entities", " ").alias("entities"), F.array_join("captions", ";").alias("captions"))


_BRIDGE = f"""{_BASE}{_TABLES}, br as (select key, text, type, file, pages, string_agg(distinct ce.e, ' ' order by ce.e) as shared, min(row(o, p)) as pt from (select *, unnest([a, b]) as e from cl) ce join ke on ke.e = ce.e group by all)"""


@query("wiki_bridge", f"{_BRIDGE} select key, text, type, file, pages, shared, struct_extract_at(pt, 1) as chunk_ord from br")
def wiki_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bridge(_comparisons(spark, sf_dir), _claims(spark, sf_dir))
    return b.select("key", "text", "type", "file", "pages", F.array_join("shared", " ").alias("shared"), F.col("at.chunk_ord").alias("chunk_ord"))


_COMPARISON_NUMBERS = """, pl as (select key, file, page::varchar as pages, row_number() over (partition by key order by file, page, title, markdown) as i from once),
  fi as (select key, file, pages, min(i) as i, null::bigint as z from pl group by all), bi as (select key, file, pages, min(pt) as b from br group by all),
  num as (select key, file, pages, (row_number() over (partition by key order by i nulls last, b, file, pages))::int as n from fi full join bi using (key, file, pages))"""


@query("wiki_comparison_citations", f"{_BRIDGE}{_COMPARISON_NUMBERS} select key, file, pages, n from num")
def wiki_comparison_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comparisons(spark, sf_dir)
    return A.comparison_citations(c, A.bridge(c, _claims(spark, sf_dir)))


@query(
    "wiki_comparison_pages",
    rf"""{_BRIDGE}{_COMPARISON_NUMBERS},
  t as (select key, string_agg('## Table: ' || title || ' (' || string_split(file, '/')[-1] || ', p. ' || page || ')' || chr(10) || chr(10) || markdown || chr(10) || chr(10) || '[^src' || n || ']', chr(10) || chr(10) order by file, page, title, markdown) as t
    from once join num using (key, file) where num.pages = page::varchar group by key),
  b as (select key, string_agg(l, chr(10) order by pt, l) as b from (select key, pt, '- ' || text || ' ([[' || type || '|Topic ' || type[7:] || ']]) [^src' || n || ']' as l from br join num using (key, file, pages)) group by key),
  s as (select key, string_agg('[^src' || n || ']: ' || string_split(file, '/')[-1] || ', pages ' || pages, chr(10) order by n) as s from num group by key)
  select key, concat_ws(chr(10) || chr(10), '# ' || array_to_string(list_transform(string_split(key, '-'), lambda w: upper(w[1]) || w[2:]), ' '), t, '## Bridge' || chr(10) || chr(10) || b, '## Sources' || chr(10) || chr(10) || s) as body from t left join b using (key) left join s using (key)""",
)
def wiki_comparison_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comparisons(spark, sf_dir)
    b = A.bridge(c, _claims(spark, sf_dir))
    return render.comparison_pages(c, b, A.comparison_citations(c, b))


_NUMBERS = """, ev as (select slug, 0 as kind, file, pages, row(o, p) as pt from ment union all select slug, 1, file, pages, pt from rel union all select slug, 2, file, pages, pt from att union all select slug, 3, file, pages, pt from inc),
  num as (select slug, file, pages, (row_number() over (partition by slug order by min(row(kind, pt)), file, pages))::int as n from ev group by slug, file, pages)"""


def _evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    known = _known(spark, sf_dir)
    rels = _rels(spark, sf_dir)
    return {
        "mentions": A.dedupe(_obs(spark, sf_dir), "mentions"),
        "relationships": A.dedupe(A.outgoing(rels, known), "relationships"),
        "claims": A.dedupe(A.mentions_of(_claims(spark, sf_dir), known), "claims"),
        "incoming": A.dedupe(A.incoming(rels, known), "incoming"),
    }


def _places(evidence: dict[str, DataFrame]) -> DataFrame:
    text = {"mentions": "context", "relationships": "evidence", "claims": "text", "incoming": "evidence"}
    out = None
    for k, name in enumerate(("mentions", "relationships", "claims", "incoming")):
        df = evidence[name].select("slug", F.lit(k).alias("kind"), "file", "pages", "chunk_ord", "pos", F.col(text[name]).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "wiki_entity_pages",
    f"""{_BASE}{_NUMBERS}, ln as (
    select slug, 'm' as k, 0 as d, row(o, p) as pt, '- Page ' || page || ': "' || context || '" [^src' || n || ']' as l from ment join num using (slug, file, pages)
    union all select rel.slug, 'r', 0, pt, '- Supplied By [[' || object || coalesce('|' || name, '') || ']] — ' || evidence || ' [^src' || n || ']' from rel join num using (slug, file, pages) left join known on known.slug = object
    union all select inc.slug, 'r', 1, pt, '- [[' || subject || coalesce('|' || name, '') || ']] Supplied By — ' || evidence || ' [^src' || n || ']' from inc join num using (slug, file, pages) left join known on known.slug = subject
    union all select slug, 'c', 0, pt, '- ' || text || ' [^src' || n || ']' from att join num using (slug, file, pages)
    union all select slug, 's', 0, row(n::bigint, null), '[^src' || n || ']: ' || string_split(file, '/')[-1] || ', pages ' || pages from num),
  sec as (select slug, k, '## ' || case k when 'm' then 'Mentions' when 'r' then 'Relationships' when 'c' then 'Claims' else 'Sources' end || chr(10) || chr(10) || string_agg(l, chr(10) order by d, pt, l) as b from ln group by slug, k)
  select slug, '# ' || name || chr(10) || chr(10) || significance || chr(10) || chr(10) || (select string_agg(b, chr(10) || chr(10) order by case k when 'm' then 0 when 'r' then 1 when 'c' then 2 else 3 end) from sec where sec.slug = known.slug) as body from known""",
)
def wiki_entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, e = _known(spark, sf_dir), _evidence(spark, sf_dir)
    numbers = A.number_citations(_places(e), "slug").withColumnRenamed("slug", "page_id")
    return render.entity_pages(known, e["mentions"], e["relationships"], e["incoming"], e["claims"], numbers, known.select("slug", F.col("name").alias("title")))


@query(
    "wiki_topic_pages",
    f"""{_BASE}, c as (select distinct type as slug, o, p, text, file, pages from cl), num as (select slug, file, pages, row_number() over (partition by slug order by min(row(o, p)), file, pages) as n from c group by slug, file, pages),
  b as (select slug, string_agg(l, chr(10) order by pt, l) as b from (select type as slug, row(o, p) as pt, '- ' || text || ' [^src' || n || ']' as l from cl join num on slug = type and num.file = cl.file and num.pages = cl.pages) group by slug),
  s as (select slug, string_agg('[^src' || n || ']: ' || string_split(file, '/')[-1] || ', pages ' || pages, chr(10) order by n) as s from num group by slug)
  select slug, '# Topic ' || slug[7:] || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || b || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || s as body from b join s using (slug)""",
)
def wiki_topic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    numbers = A.number_citations(c.withColumn("kind", F.lit(0)).withColumnRenamed("type", "page_id"))
    return render.topic_pages(A.topics(c), numbers)


@query(
    "wiki_evidence_lists",
    f"""{_BASE} select slug, coalesce(m.n, 0)::int as mentions, coalesce(r.n, 0)::int as relationships, coalesce(c.n, 0)::int as claims, coalesce(m.n, 0) <= 2 and coalesce(r.n, 0) = 0 and coalesce(c.n, 0) = 0 as sparse, m.first as first_mention
    from known left join (select slug, count(*) as n, arg_min(context, row(o, p)) as first from ment group by 1) m using (slug) left join (select slug, count(*) as n from rel group by 1) r using (slug) left join (select slug, count(*) as n from att group by 1) c using (slug)""",
)
def wiki_evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    lists = A.with_evidence(_known(spark, sf_dir), **{k: e[k] for k in ("mentions", "relationships", "claims")})
    sizes = [F.size(k).alias(k) for k in ("mentions", "relationships", "claims")]
    return lists.select("slug", *sizes, A.is_sparse(F.col("mentions"), F.col("relationships"), F.col("claims")).alias("sparse"), F.get("mentions", F.lit(0))["context"].alias("first_mention"))


# ---- composites: the suppliers of a nation are one cluster each

_MEMBERS = """, mb as (select min('e-' || s_suppkey) over (partition by s_nationkey) as "into", (row_number() over (partition by s_nationkey order by 'e-' || s_suppkey) - 1)::int as pos, 'e-' || s_suppkey as slug from supplier)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(_slug("s_suppkey"))).alias("members"))
    return g.select("members", F.col("members")[0].alias("into"), F.col("s_nationkey").alias("at"))


@query("wiki_clusters", f"{_BASE}{_MEMBERS} select slug, null as \"into\", null::int as pos from known where slug not in (select slug from mb) union all select slug, \"into\", pos from mb")
def wiki_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters decided for each survivor: that of one member less is later and has no effect."""
    c = _clusters(spark, sf_dir)
    later = c.select(F.slice("members", 1, 1).alias("members"), "into", (F.col("at") + 1000).alias("at"))
    stay, members = curate.apply_clusters(_known(spark, sf_dir), later.unionByName(c))
    return stay.select("slug", F.lit(None).cast("string").alias("into"), F.lit(None).cast("int").alias("pos")).unionByName(members.select("slug", "into", "pos"))


_COMPOSITE_NUMBERS = f"""{_BASE}{_NUMBERS}{_MEMBERS}, cnum as (select "into", file, pages, (row_number() over (partition by "into" order by min(row(kind, pos, pt)), file, pages))::int as n from mb join ev using (slug) group by "into", file, pages)"""


@query("wiki_composite_citations", f"{_COMPOSITE_NUMBERS} select * from cnum")
def wiki_composite_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = curate.apply_clusters(_known(spark, sf_dir), _clusters(spark, sf_dir))
    return A.composite_citations(members, _places(_evidence(spark, sf_dir)))


@query(
    "wiki_composite_pages",
    f"""{_COMPOSITE_NUMBERS}, tx as (select slug, 0 as kind, file, pages, row(o, p) as pt, context as text from ment union all select slug, 1, file, pages, pt, evidence from rel union all select slug, 2, file, pages, pt, text from att union all select slug, 3, file, pages, pt, evidence from inc),
  names as (select "into", string_agg(upper(slug[1]) || ' ' || slug[3:], ' — ' order by pos) as title, string_agg('- ' || upper(slug[1]) || ' ' || slug[3:], chr(10) order by pos) as b from mb group by 1),
  li2 as (select "into", pos, kind, pt, '- ' || upper(slug[1]) || ' ' || slug[3:] || ': ' || text || ' [^src' || n || ']' as l from mb join tx using (slug) join cnum using ("into", file, pages)),
  ev2 as (select "into", string_agg(l, chr(10) order by pos, kind, pt, l) as b from li2 group by 1), s as (select "into", string_agg('[^src' || n || ']: ' || string_split(file, '/')[-1] || ', pages ' || pages, chr(10) order by n) as b from cnum group by 1)
  select names."into", concat_ws(chr(10) || chr(10), '# ' || title, '## Members' || chr(10) || chr(10) || names.b, '## Evidence' || chr(10) || chr(10) || ev2.b, '## Sources' || chr(10) || chr(10) || s.b) as body from names left join ev2 using ("into") left join s using ("into")""",
)
def wiki_composite_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = curate.apply_clusters(_known(spark, sf_dir), _clusters(spark, sf_dir))
    members = members.withColumn("title", T.title_case("slug"))
    places = _places(_evidence(spark, sf_dir))
    return render.composite_pages(A.composite(members, places), members, A.composite_citations(members, places), places)


@query(
    "wiki_composite_incoming",
    f"""{_BASE}{_MEMBERS} select i."into", inc.slug, subject, page, file from inc join mb i on i.slug = inc.slug where not exists (select 1 from rel join mb m on m.slug = rel.slug where m."into" = i."into" and rel.slug = inc.subject and rel.slug <> inc.slug and rel.object = inc.slug and rel.page = inc.page and rel.file = inc.file and rel.pages = inc.pages)""",
)
def wiki_composite_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming edges of members, without those that another member shows as outgoing."""
    _, members = curate.apply_clusters(_known(spark, sf_dir), _clusters(spark, sf_dir))
    e = _evidence(spark, sf_dir)
    m = members.select("into", "slug")
    return A.without_member_edges(m.join(e["incoming"], "slug"), m.join(e["relationships"], "slug")).select("into", "slug", "subject", "page", "file")


@query(
    "wiki_composite_related",
    f"""{_BASE}{_MEMBERS}, e as (select a as x, b as y from li where k = 'A' union all select b, a from li where k = 'A' union all select a, b from cl union all select b, a from cl),
  r as (select distinct "into", y from mb join e on x = slug where y <> x and not exists (select 1 from mb z where z."into" = mb."into" and z.slug = y)) select "into", count(*)::bigint as n, min(y) as first from r group by 1""",
)
def wiki_composite_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = curate.apply_clusters(_known(spark, sf_dir), _clusters(spark, sf_dir))
    r = A.related_composite(members, _rels(spark, sf_dir), _claims(spark, sf_dir))
    return r.select("into", F.size("related").cast("bigint").alias("n"), F.col("related")[0].alias("first"))


@query("wiki_comparison_related", f"{_BRIDGE}, e as (select key, e from ke union select key, unnest([a, b]) from (select distinct key, cl.a, cl.b from cl join ke on ke.e = cl.a or ke.e = cl.b)) select key, string_agg(e, ' ' order by e) as related from e where key <> e group by key")
def wiki_comparison_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, claims = _comparisons(spark, sf_dir), _claims(spark, sf_dir)
    shares = c.select("key", F.explode("entities").alias("e")).join(claims.select("entities", F.explode("entities").alias("e")), "e").select("key", "entities").distinct()
    return A.related_comparison(c, shares).select("key", F.array_join("related", " ").alias("related"))


# ---- merges: a part's entity goes to that of its size, which is known from the disk or otherwise unknown

_MERGES = """, mg as (select 'e-' || p_partkey as old, 'm-' || p_size as new from part), disk as (select distinct 'm-' || c_nationkey as slug, case when c_nationkey > 9 then 'Size ' || c_nationkey else '' end as title, 'size' as type, 'entities/sizes' as folder from customer)"""


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_slug("p_partkey").alias("old"), F.concat(F.lit("m-"), F.col("p_size").cast("string")).alias("new"))


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("m-"), n).alias("slug"), F.when(F.col("c_nationkey") > 9, F.concat(F.lit("Size "), n)).otherwise("").alias("title"), F.lit("size").alias("type"), F.lit("entities/sizes").alias("folder")).distinct()


@query(
    "wiki_entity_merges",
    f"""{_BASE}{_MERGES}, v as (select new, old, coalesce(name, upper(old[1]) || ' ' || old[3:]) as t, coalesce(n_obs, 0) as n from mg left join known on slug = old), g as (select new, string_agg(t, '|' order by old) as aliases, sum(n)::bigint as n_obs from v group by new)
  select new as slug, case when coalesce(title, '') <> '' then title else 'M ' || new[3:] end as name, coalesce(type, 'unknown') as type, coalesce(folder, 'entities') as folder, aliases, n_obs from g left join disk on disk.slug = new
  union all select slug, name, type, coalesce(mem.folder, known.folder), '', n_obs from known left join mem using (slug) where slug not in (select old from mg)""",
)
def wiki_entity_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>"))
    return A.merge_entities(known, _merges(spark, sf_dir), _disk(spark, sf_dir)).select("slug", "name", "type", "folder", F.array_join("aliases", "|").alias("aliases"), "n_obs")


@query(
    "wiki_remap",
    f"{_BASE}{_MERGES} select o as chunk_ord, coalesce(x.new, li.a) as subject, coalesce(y.new, li.b) as object, count(*)::bigint as n from li left join mg x on x.old = li.a left join mg y on y.old = li.b where k = 'A' group by all",
)
def wiki_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _merges(spark, sf_dir)
    return A.remap(A.remap(_rels(spark, sf_dir), "subject", m), "object", m).groupBy("chunk_ord", "subject", "object").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wiki_remap_lists",
    f"{_BASE}{_MERGES}, c as (select distinct o, a, b from cl) select o as chunk_ord, a || ' ' || b as was, case when coalesce(x.new, a) = coalesce(y.new, b) then coalesce(x.new, a) else coalesce(x.new, a) || ' ' || coalesce(y.new, b) end as entities from c left join mg x on x.old = a left join mg y on y.old = b",
)
def wiki_remap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir).select("chunk_ord", F.array_join("entities", " ").alias("was"), "entities").dropDuplicates(["chunk_ord", "was"])
    return A.remap_array(c, "entities", _merges(spark, sf_dir), ["chunk_ord", "was"]).select("chunk_ord", "was", F.array_join("entities", " ").alias("entities"))


@query(
    "wiki_candidates",
    f"""{_BASE}, r as (select slug, text, row_number() over (partition by slug order by pt, text) as i, count(*) over (partition by slug) as n from att), s as (select slug, max(n)::bigint as n, string_agg(text, '|' order by i) as samples from r where i <= 3 group by slug),
  dk as (select 'e-' || (c_custkey * 3) as slug, c_name as title, c_mktsegment as folder, c_nationkey::bigint as n, c_mktsegment || '|' || c_name as samples from customer)
  select slug, name as title, coalesce(mem.folder, known.folder) as folder, coalesce(s.n, 0) as n, coalesce(samples, '') as samples, slug in (select slug from dk) as on_disk, 0 as rank from known left join mem using (slug) left join s using (slug)
  union all select slug, title, folder, n, samples, true, 1 from dk where slug not in (select slug from known)""",
)
def wiki_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers play the pages on disk."""
    known = _known(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>"))
    disk = table(spark, sf_dir, "customer").select(F.concat(F.lit("e-"), (F.col("c_custkey") * 3).cast("string")).alias("slug"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("folder"), F.col("c_nationkey").alias("n"), F.array("c_mktsegment", "c_name").alias("samples"), F.array("c_name").alias("aliases"))
    items = A.dedupe(A.mentions_of(_claims(spark, sf_dir), _known(spark, sf_dir)), "claims").withColumn("pos", F.struct("pos", "text"))
    c = A.candidates(known, items, disk, "text", 3)
    return c.select("slug", "title", "folder", "n", F.array_join("samples", "|").alias("samples"), "on_disk", F.col("pos.k").alias("rank"))


@query(
    "wiki_forks",
    f"""{_BASE} select 'entities/' || c_mktsegment || '/e-' || c_custkey || '.md' as path, coalesce(mem.folder, known.folder) || '/e-' || c_custkey || '.md' as canonical, case when c_acctbal > 0 then 'remove' else 'review' end as action from customer join known on slug = 'e-' || c_custkey left join mem using (slug)""",
)
def wiki_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of customers lie in their segment's folder, written by hand where the balance is not positive."""
    h = F.sha2("c_name", 256)
    pages = table(spark, sf_dir, "customer").select(_slug("c_custkey").alias("slug"), F.concat_ws("/", F.lit("entities"), "c_mktsegment", F.concat(_slug("c_custkey"), F.lit(".md"))).alias("path"), h.alias("hash"), F.when(F.col("c_acctbal") > 0, h).alias("recorded"))
    return A.fork_duplicates(pages, _known(spark, sf_dir))


@query(
    "wiki_provenance",
    "select o_orderkey as chunk_id, 'f' || o_custkey as file from orders where o_orderstatus <> 'P' and o_custkey in (select c_custkey from customer where c_acctbal > 0)",
)
def wiki_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a known customer of positive balance, or pending, have no file or no pages."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("ok"))
    o = table(spark, sf_dir, "orders").join(rich, "o_custkey", "left")
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("chunk_ord"), F.when(F.col("ok"), F.concat(F.lit("f"), F.col("o_custkey").cast("string"))).alias("file"), F.when(F.col("o_orderstatus") == "P", "").otherwise("1").alias("pages"))
    return A.with_provenance(o.select(F.col("o_orderkey").alias("chunk_id")), chunks).select("chunk_id", "file")


@query("wiki_sources", "select distinct 'order-' || o_custkey as source from orders")
def wiki_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), F.col("o_custkey").cast("string"), F.lit("-part-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")).alias("chunk_id"))
    return A.source_slugs(r)


# ---- extraction records

@query(
    "extraction_records",
    """with l as (select l_orderkey as o, count(*) filter (l_returnflag = 'R') as e, count(*) filter (l_returnflag = 'A') as r, count(*) filter (l_returnflag = 'N') as c, count(*) filter (l_returnflag = 'N' and l_linestatus = 'F') as f,
    count(*) filter (l_returnflag = 'R' and l_linenumber > 5) as bad_page, count(*) filter (l_returnflag = 'R') as slugs, min(case when l_returnflag = 'R' then 'part-' || l_partkey end) as first_slug from lineitem group by 1)
    select 'o-' || o as chunk_id, e::bigint as entities, r::bigint as relationships, c::bigint as claims, f::bigint as status_f, coalesce(first_slug, '') as first_slug, bad_page::bigint as outside from l""",
)
def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor's replies, one an order, in a code fence: parsed, normalised, counted and checked against pages 1-5."""
    li = table(spark, sf_dir, "lineitem")
    is_ = lambda f: F.col("l_returnflag") == f
    name = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    ent = F.struct(name.alias("name"), F.col("l_linestatus").alias("type"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("slug"), F.lit("entities/Some Folder").alias("folder"), F.lit("s").alias("significance"), F.array(F.struct(F.col("l_linenumber").alias("page"), F.lit("c").alias("context"))).alias("mentions"))
    rel = F.struct(name.alias("subject"), F.lit("by").alias("predicate"), F.lit("x").alias("object"), F.lit("e").alias("evidence"), F.lit(1).alias("page"))
    claim = F.struct(F.lit("t").alias("text"), F.concat(F.lit("Status "), "l_linestatus").alias("type"), F.array(name).alias("entities"), F.lit(1).alias("page"))
    pick = lambda f, v: F.array_sort(F.collect_list(F.when(is_(f), v)))
    rec = li.groupBy("l_orderkey").agg(F.to_json(F.struct(pick("R", ent).alias("entities"), pick("A", rel).alias("relationships"), pick("N", claim).alias("claims"), F.lit("ctx").alias("context"))).alias("j"))
    chunk = F.concat(F.lit("o-"), F.col("l_orderkey").cast("string"))
    parsed = extract.normalise(extract.parse_replies(rec.select(chunk.alias("chunk_id"), F.concat(F.lit("```json\n"), "j", F.lit("\n```")).alias("reply"))))
    outside = F.size(F.filter(extract.issues_of(parsed, F.lit("1-5")), lambda x: x["issue"] == "page outside the chunk")).cast("bigint")
    checked = parsed.withColumn("first_slug", F.array_min(F.transform("entities", lambda e: e["slug"]))).withColumn("outside", outside)
    n = ingest.extraction_counters(checked, "first_slug", "outside")
    return n.select("chunk_id", "entities", "relationships", "claims", F.coalesce(F.try_element_at("claimsByType", F.lit("status-f")), F.lit(0)).alias("status_f"), F.coalesce("first_slug", F.lit("")).alias("first_slug"), "outside")


# ---- preservation on the documents and on tables of orders

_MISSING = """with e as (select doc_id, 'lang' as kind, lang || ' ' as text from documents union all select doc_id, 'source', source from documents union all select doc_id, 'own', text[3:40] from documents)
  select doc_id, kind, e.text from e join documents d using (doc_id) where trim(e.text, ' ' || chr(9) || chr(10) || chr(13)) <> '' and not contains(d.text, e.text)"""


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("body"), "lang", "source")
    e = d.select("path", F.explode(F.array(F.struct(F.lit("lang").alias("kind"), F.concat("lang", F.lit(" ")).alias("text")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("text")), F.struct(F.lit("own").alias("kind"), F.substring("body", 3, 38).alias("text")))).alias("x")).select("path", "x.*")
    return preserve.missing_evidence(d.select("path", "body"), e)


@query("wiki_missing_evidence", _MISSING)
def wiki_missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its language, its source and a piece of itself."""
    return _missing(spark, sf_dir).select(F.col("path").alias("doc_id"), "kind", "text")


@query("wiki_feedback", f"with m as ({_MISSING}) select doc_id, string_agg(distinct '- Missing from the page: ' || kind || ' ' || text, chr(10) order by '- Missing from the page: ' || kind || ' ' || text) as feedback from m group by doc_id")
def wiki_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preserve.feedback(_missing(spark, sf_dir).withColumn("what", F.concat_ws(" ", "kind", "text"))).select(F.col("path").alias("doc_id"), "feedback")


_CITED = """with li as (select distinct l_orderkey as o, l_linenumber as n from lineitem), c as (select distinct l_orderkey as o, l_linenumber as n from lineitem where l_returnflag <> 'R')"""


def _cited_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages that cite each line number of an order, a line each; the map has those of lines not returned."""
    n = F.col("l_linenumber").cast("string")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber", F.concat(F.lit("line [^src"), n, F.lit("]")).alias("l"), F.concat(F.lit("src"), n).alias("key"), "l_returnflag")
    pages = li.select("path", "l_linenumber", "l").distinct().groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l"))), lambda x: x["l"]), "\n").alias("body"))
    return pages, li.where("l_returnflag <> 'R'").select("path", "key").distinct()


@query("wiki_off_map_citations", f"{_CITED}, r as (select o, n, row_number() over (partition by o order by n) as line from li) select o as path, 'src' || n as key, line::int as line, 'line [^src' || n || ']' as text from r where (o, n) not in (select (o, n) from c)")
def wiki_off_map_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preserve.off_map_citations(*_cited_pages(spark, sf_dir))


@query("wiki_missing_citations", "select distinct l_orderkey as path, 'src' || (l_linenumber + 3) as key from lineitem l where not exists (select 1 from lineitem m where m.l_orderkey = l.l_orderkey and m.l_linenumber = l.l_linenumber + 3)")
def wiki_missing_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = _cited_pages(spark, sf_dir)
    want = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("src"), (F.col("l_linenumber") + 3).cast("string")).alias("key")).distinct()
    return preserve.missing_citations(pages, want)


@query(
    "wiki_missing_row_values",
    """with r as (select l_orderkey as o, l_linenumber as n, l_partkey as a, l_suppkey as b, l_quantity::bigint as q, l_returnflag as k from lineitem),
    sc as (select o, string_agg('| L' || n || ' | ' || (case when k = 'R' then q + 100 else q end) || ' | ' || a || ' |', chr(10) order by n, a, b, q, k) as rows from r group by o),
    s as (select o, '## Table: Lines (f.pdf, p. 1)' || chr(10) || chr(10) || '| line | quantity | part |' || chr(10) || rows as scope from sc),
    v as (select o, n, a, b, q, k, unnest(list_distinct([q::varchar, a::varchar, b::varchar])) as value from r)
    select o as path, 'L' || n as subject, value, count(*)::bigint as times from v join s using (o) where not contains(scope, value) group by all""",
)
def wiki_missing_row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of an order shows other quantities of the lines returned, and no suppliers."""
    text = lambda c: F.col(c).cast("string")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), "l_returnflag")
    shown = F.when(F.col("l_returnflag") == "R", F.col("q") + 100).otherwise(F.col("q")).cast("string")
    n = F.concat(F.lit("L"), text("l_linenumber"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "q", "l_returnflag"]
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    made = li.select("path", *order, row(n, shown, text("l_partkey")).alias("s"), row(n, text("q"), text("l_partkey"), text("l_suppkey")).alias("t"))
    g = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*order, "s", "t"))).alias("r"))
    join = lambda f: F.array_join(F.transform("r", lambda x: x[f]), "\n")
    pages = g.select("path", F.concat(F.lit("# T\n\n## Table: Lines (f.pdf, p. 1)\n\n| line | quantity | part |\n"), join("s")).alias("body"))
    tables = g.select("path", F.lit("raw/f.pdf").alias("file"), F.lit(1).alias("page"), F.concat(F.lit("| line | quantity | part | supplier |\n| --- | --- | --- | --- |\n"), join("t")).alias("markdown"))
    m = preserve.missing_row_values(pages, tables)
    return m.groupBy("path", "subject", "value").agg(F.count(F.lit(1)).alias("times"))
