"""Aggregation of extraction records into entities, topics, comparisons and documents.

Every exploded row carries its place ``(chunk_ord, pos)``: order decides which value is the first, how citations are
numbered and which edges attach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.dedup import keep_first
from folioforge.operators.registry import query
from folioforge.sources.tables import table

ORD = ("chunk_ord", "pos")


def explode_section(records: DataFrame, section: str) -> DataFrame:
    """records(chunk_id, <section>: array of structs) joined to chunks: one row an item with its place."""
    return records.select("chunk_id", "chunk_ord", "file", "pages", F.posexplode(section).alias("pos", "item")).select("chunk_id", "chunk_ord", "file", "pages", "pos", "item.*")


def with_provenance(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records of chunks whose source file and pages are known; chunks(chunk_id, chunk_ord, file, pages)."""
    known = chunks.where((F.coalesce("file", F.lit("")) != "") & (F.coalesce("pages", F.lit("")) != ""))
    return records.join(known.select("chunk_id", "chunk_ord", "file", "pages"), "chunk_id")


def source_slugs(records: DataFrame) -> DataFrame:
    """Every source with a record, those without provenance too."""
    return records.select(T.chunk_source("chunk_id").alias("source")).distinct()


def entities(obs: DataFrame, memory: DataFrame) -> DataFrame:
    """First-seen scalars by slug; obs(slug, name, type, folder, significance[, disambiguation], chunk_ord, pos), memory(slug, folder).

    The folder of earlier runs goes before the first-seen one.
    """
    place = F.struct(*ORD)
    g = obs.groupBy("slug").agg(*[F.min_by(c, place).alias(c) for c in ("name", "type", "folder", "significance", "disambiguation") if c in obs.columns], F.min(place).alias("first_at"), F.count(F.lit(1)).alias("n_obs"))
    return g.join(memory.select("slug", F.col("folder").alias("__m")), "slug", "left").withColumn("folder", F.coalesce("__m", "folder")).drop("__m")


def attach(items: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Items whose ``key`` is an entity already seen when their chunk is processed: an equi join with an inequality.

    Entities of the same chunk are seen first. What names an entity of a later chunk is dropped.
    """
    seen = known.select(F.col("slug").alias("__slug"), F.col("first_at.chunk_ord").alias("__first"))
    return items.join(seen, (F.col(key) == F.col("__slug")) & (F.col("__first") <= F.col("chunk_ord"))).drop("__first").withColumnRenamed("__slug", "slug")


def outgoing(rels: DataFrame, known: DataFrame) -> DataFrame:
    return attach(rels, "subject", known)


def incoming(rels: DataFrame, known: DataFrame) -> DataFrame:
    """Edges at their object, without self loops."""
    return attach(rels.where("object <> subject"), "object", known)


def mentions_of(items: DataFrame, known: DataFrame) -> DataFrame:
    """Claims or timeline events at each entity of their ``entities``; one named twice attaches twice."""
    return attach(items.withColumn("__e", F.explode("entities")), "__e", known).drop("__e")


def contexts(records: DataFrame, obs: DataFrame) -> DataFrame:
    """``(slug, contexts)``: distinct contexts of the chunks an entity is in, and of no other."""
    here = obs.select("chunk_id", "slug").distinct()
    return here.join(records.select("chunk_id", "context").where(T.strip("context") != ""), "chunk_id").groupBy("slug").agg(F.array_sort(F.collect_set("context")).alias("contexts"))


#: Keys of the keep-first dedupes; evidence is shown but not in the key, so the first one stays.
KEYS = {
    "mentions": ("slug", "page", "context", "file", "pages"),
    "relationships": ("slug", "subject", "predicate", "object", "page", "file", "pages"),
    "incoming": ("slug", "subject", "predicate", "page", "file", "pages"),
    "claims": ("slug", "text", "type", "page", "file", "pages", "entities"),
    "timeline": ("slug", "date", "event", "entities"),
}


def dedupe(items: DataFrame, kind: str) -> DataFrame:
    return keep_first(items, KEYS[kind], ORD)


def topic_heads(claims: DataFrame) -> DataFrame:
    """``(slug, title, n_claims, first_at)`` without the claims themselves: what a roll-up over topics of any size needs."""
    g = claims.groupBy(F.col("type").alias("slug")).agg(F.count(F.lit(1)).alias("n_claims"), F.min(F.struct(*ORD)).alias("first_at"))
    return g.withColumn("title", T.title_case("slug"))


def with_evidence(known: DataFrame, **lists: DataFrame) -> DataFrame:
    """``known`` with a column a kind: its de-duplicated items(slug, chunk_ord, pos, ...) as an array in order, empty where there
    are none. One entity's lists are one page's content and are put together only here; everything before works on rows."""
    out = known
    for kind, items in lists.items():
        once = dedupe(items, kind) if kind in KEYS else items
        rest = [c for c in once.columns if c not in ("slug", *ORD)]
        g = once.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(*ORD, *rest))).alias(kind))
        out = out.join(g, "slug", "left").withColumn(kind, F.coalesce(kind, F.array().cast(g.schema[kind].dataType)))
    return out


def merge_entities(known: DataFrame, merges: DataFrame, disk: DataFrame) -> DataFrame:
    """Entities of known(slug, name, type, folder, significance, aliases, first_at, n_obs) after merges(old, new).

    A survivor keeps its own scalars; one that is only on disk(slug, title, type, folder) takes them from there, else from its slug,
    type unknown and folder entities. Names of the merged away, their own aliases before them, become its aliases, each once.
    """
    on = disk.select("slug", F.col("title").alias("__t"), F.col("type").alias("__y"), F.col("folder").alias("__f"))
    titled = F.coalesce(F.when(F.col("__t") != "", F.col("__t")), T.title_case("slug"))
    none = F.array().cast("array<string>")
    away = merges.select(F.col("old").alias("slug"), "new").distinct().join(known, "slug", "left").join(on, "slug", "left")
    names = away.select("new", "slug", F.concat(F.coalesce("aliases", none), F.array(F.coalesce("name", titled))).alias("a"), "first_at", F.coalesce("n_obs", F.lit(0)).alias("n"))
    got = names.groupBy(F.col("new").alias("slug")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slug", "a"))), lambda x: x["a"])).alias("__a"), F.sum("n").alias("__n"), F.min("first_at").alias("__at"))
    stay = known.join(merges.select(F.col("old").alias("slug")).distinct(), "slug", "left_anti")
    m = stay.withColumn("__k", F.lit(True)).join(got, "slug", "full").where("__k or __a is not null").join(on, "slug", "left")
    return m.select(
        "slug",
        F.coalesce("name", titled).alias("name"),
        F.coalesce("type", "__y", F.lit("unknown")).alias("type"),
        F.coalesce("folder", "__f", F.lit("entities")).alias("folder"),
        F.coalesce("significance", F.lit("")).alias("significance"),
        F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("__a", none))).alias("aliases"),
        F.coalesce("first_at", "__at").alias("first_at"),
        (F.coalesce("n_obs", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("n_obs"),
    )


def candidates(known: DataFrame, items: DataFrame, disk: DataFrame, text: str, most: int) -> DataFrame:
    """``(pos, slug, title, folder, n, samples, aliases, on_disk)``: what curation judges.

    known(slug, name, folder, aliases, first_at) with the number of its de-duplicated items(slug, chunk_ord, pos, text) and the first
    ``most`` of them, in the order of first appearance; then what only disk(slug, title, folder, n, samples, aliases) has, by slug.
    """
    n = items.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    none = F.array().cast("array<string>")
    d = disk.select("slug", F.coalesce("aliases", none).alias("__al"), F.lit(True).alias("__d"))
    live = known.join(n, "slug", "left").join(samples(items, "slug", text, most), "slug", "left").join(d, "slug", "left")
    live = live.select(F.struct(F.lit(0).alias("k"), F.col("first_at.chunk_ord").alias("c"), F.col("slug").alias("s")).alias("pos"), "slug", F.col("name").alias("title"), "folder", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("samples", none).alias("samples"), F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("__al", none))).alias("aliases"), F.coalesce("__d", F.lit(False)).alias("on_disk"))
    first = live.schema["pos"].dataType["c"].dataType
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(T.title_case("slug"))
    gone = disk.join(known.select("slug"), "slug", "left_anti")
    gone = gone.select(F.struct(F.lit(1).alias("k"), F.lit(None).cast(first).alias("c"), F.col("slug").alias("s")).alias("pos"), "slug", titled.alias("title"), "folder", F.col("n").cast("bigint").alias("n"), F.transform(F.slice(F.coalesce("samples", none), 1, most), lambda x: T.truncate_sample(x)).alias("samples"), F.coalesce("aliases", none).alias("aliases"), F.lit(True).alias("on_disk"))
    return live.unionByName(gone)


def topics(claims: DataFrame) -> DataFrame:
    """``(slug, title, claims)``: claims by their type, in order."""
    one = F.struct("chunk_ord", "pos", "text", "entities", "page", "file", "pages")
    return claims.groupBy(F.col("type").alias("slug")).agg(F.array_sort(F.collect_list(one)).alias("claims")).withColumn("title", T.title_case("slug"))


def without_own_edges(inc: DataFrame, out: DataFrame) -> DataFrame:
    """Incoming edges that the entity doesn't show as its own outgoing ones."""
    key = ["slug", "subject", "object", "predicate", "page", "file", "pages"]
    return inc.join(out.select(*key).distinct(), key, "left_anti")


def without_member_edges(inc: DataFrame, out: DataFrame) -> DataFrame:
    """Incoming edges inc(into, slug, subject, ...) of a composite's members that no other member of it shows as its own outgoing
    ones, out(into, slug, subject, object, ...)."""
    o = out.select(*[F.col(c).alias(f"__{c}") for c in ("into", "slug", "subject", "object", "predicate", "page", "file", "pages")]).distinct()
    same = (F.col("into") == F.col("__into")) & (F.col("slug") == F.col("__object"))
    for c in ("subject", "predicate", "page", "file", "pages"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return inc.join(o, same & (F.col("slug") != F.col("__slug")), "left_anti")


def fork_duplicates(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, canonical, action)`` of pages(path, slug, hash, recorded) that lie elsewhere than their entity of known(slug, folder):
    removed if unchanged since written, else kept for review."""
    at = known.select("slug", F.concat_ws("/", "folder", F.concat("slug", F.lit(".md"))).alias("canonical"))
    action = F.when(F.col("recorded") == F.col("hash"), "remove").otherwise("review")
    return pages.join(at, "slug").where("path <> canonical").select("path", "canonical", action.alias("action"))


def topic_titles(claims: DataFrame, titles: DataFrame) -> DataFrame:
    """``(slug, titles)``: the distinct titles of a topic's entities, sorted; a slug without a title speaks for itself."""
    e = claims.select(F.col("type").alias("topic"), F.explode("entities").alias("slug")).distinct().join(titles.select("slug", "title"), "slug", "left")
    return e.groupBy(F.col("topic").alias("slug")).agg(F.array_sort(F.collect_set(F.coalesce("title", "slug"))).alias("titles"))


def by_title(df: DataFrame, title: str = "title") -> DataFrame:
    """In the order people read titles in: letters before case and accents. Slugs need none, their alphabet sorts as it is."""
    return df.orderBy(F.collate(title, "UNICODE"))


def comparisons(tables: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, sections, entities, captions)`` of tables(subject, title, page, markdown, entities, file, pages, chunk_ord, pos).

    The key is the subject where that is an entity, else the title's slug; blank titles, tables and keys go.
    """
    s = tables.join(known.select(F.col("slug").alias("subject"), F.lit(True).alias("__k")), "subject", "left")
    s = s.withColumn("key", F.when(F.col("__k"), F.col("subject")).otherwise(T.slugify("title"))).where((T.strip("title") != "") & (T.strip("markdown") != "") & (F.col("key") != ""))
    once = keep_first(s, ["key", "file", "page", "title", "markdown"], ORD)
    section = F.struct("file", "page", "title", "markdown")
    none = F.array().cast("array<string>")
    return once.groupBy("key").agg(F.array_sort(F.collect_list(section)).alias("sections"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("entities", none))))).alias("entities"), F.array_sort(F.collect_set("title")).alias("captions"))


def bridge(comparison: DataFrame, claims: DataFrame) -> DataFrame:
    """``(key, text, type, file, pages, shared)``: claims that share an entity with a comparison's tables."""
    e = comparison.select("key", F.explode("entities").alias("e"))
    c = claims.select("text", "type", "file", "pages", *ORD, F.explode("entities").alias("e"))
    # a claim meets a comparison once for each entity they share
    g = e.join(c, "e").groupBy("key", "text", "type", "file", "pages").agg(F.array_sort(F.collect_set("e")).alias("shared"), F.min(F.struct(*ORD)).alias("at"))
    return g


def number_citations(evidence: DataFrame, page: str = "page_id", kind: str = "kind", order: tuple[str, ...] = ORD) -> DataFrame:
    """``(page, file, pages, n)``: source places numbered by first appearance; ``kind`` ranks mentions, relations, claims, incoming."""
    first = evidence.groupBy(page, "file", "pages").agg(F.min(F.struct(kind, *order)).alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(page).orderBy("at", "file", "pages"))).drop("at")


def composite_citations(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(into, file, pages, n)``: evidence(slug, kind, file, pages, chunk_ord, pos) of all members(into, pos, slug), kind by kind, in
    the order of the members within a kind."""
    e = members.select("into", F.col("pos").alias("member"), "slug").join(evidence, "slug")
    return number_citations(e, "into", "kind", ("member", *ORD))


def comparison_citations(comparison: DataFrame, claims: DataFrame) -> DataFrame:
    """``(key, file, pages, n)``: the tables of comparison(key, sections) in their order, each with its page, then the claims of the
    bridge, claims(key, file, pages, at)."""
    t = comparison.select("key", F.posexplode("sections").alias("i", "s")).select("key", "s.file", F.col("s.page").cast("string").alias("pages"), F.struct(F.lit(0).alias("k"), "i").alias("at"))
    first = t.groupBy("key", "file", "pages").agg(F.min("at.i").alias("i"))
    b = claims.groupBy("key", "file", "pages").agg(F.min("at").alias("b"))
    every = first.join(b, ["key", "file", "pages"], "full")
    w = Window.partitionBy("key").orderBy(F.col("i").isNull(), "i", "b", "file", "pages")
    return every.withColumn("n", F.row_number().over(w)).select("key", "file", "pages", "n")


def frontmatter_sources(evidence: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, file, pages)``: sorted distinct page ranges of each file, joined."""
    return evidence.groupBy(page, "file").agg(F.array_join(F.array_sort(F.collect_set("pages")), ", ").alias("pages"))


def is_sparse(mentions: Column, rels: Column, claims: Column) -> Column:
    return (F.size(mentions) <= 2) & (F.size(rels) == 0) & (F.size(claims) == 0)


def related(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """``(slug, related)``: distinct neighbours by edges of either direction and by common claims, without the entity."""
    e = edges.select(F.col("subject").alias("slug"), F.col("object").alias("other")).union(edges.select("object", "subject"))
    pairs = claims.select(F.explode("entities").alias("slug"), "entities").select("slug", F.explode("entities").alias("other"))
    return e.union(pairs).where("slug <> other").groupBy("slug").agg(F.array_sort(F.collect_set("other")).alias("related"))


def related_composite(members: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """``(into, related)``: neighbours of a composite's members(into, slug) that are no members of it."""
    r = related(edges, claims).select("slug", F.explode("related").alias("other"))
    m = members.select("into", "slug").distinct()
    other = m.join(r, "slug").select("into", F.col("other").alias("slug")).distinct().join(m, ["into", "slug"], "left_anti")
    return other.groupBy("into").agg(F.array_sort(F.collect_set("slug")).alias("related"))


def related_comparison(comparison: DataFrame, claims: DataFrame) -> DataFrame:
    """``(key, related)``: entities of a comparison's tables and of its bridge's claims(key, entities), without the key itself."""
    e = comparison.select("key", F.explode("entities").alias("other")).union(claims.select("key", F.explode("entities")))
    return e.where("key <> other").groupBy("key").agg(F.array_sort(F.collect_set("other")).alias("related"))


def samples(items: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """The first ``most`` texts of each key, truncated."""
    w = Window.partitionBy(key).orderBy(*ORD)
    top = items.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", T.truncate_sample(text).alias("t")))), lambda x: x["t"]).alias("samples"))


def composite(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(into, title, items)``: evidence of 2 to 4 members in the members' order; members(into, pos, slug, title[, aliases, contexts]),
    whose aliases and contexts are pooled, evidence(slug, kind, chunk_ord, pos, text)."""
    none = F.array().cast("array<string>")
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, none))))).alias(c) for c in ("aliases", "contexts") if c in members.columns]
    titles = members.groupBy("into").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), " — ").alias("title"), *lists)
    e = members.select("into", F.col("pos").alias("member"), "slug").join(evidence.withColumnRenamed("pos", "at"), "slug")
    items = e.groupBy("into").agg(F.array_sort(F.collect_list(F.struct("member", "kind", "chunk_ord", "at", "slug", "text"))).alias("items"))
    return titles.join(items, "into", "left")


def remap(items: DataFrame, column: str, map_: DataFrame) -> DataFrame:
    """A slug column through map_(old, new); others stay."""
    m = map_.select(F.col("old").alias(column), F.col("new").alias("__new"))
    return items.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def remap_array(items: DataFrame, column: str, map_: DataFrame, key: list[str]) -> DataFrame:
    """An array of slugs through map_(old, new), order kept, repetitions dropped. ``key`` identifies a row."""
    e = items.select(*key, F.posexplode_outer(column).alias("__p", "__s"))
    m = map_.select(F.col("old").alias("__s"), F.col("new").alias("__new"))
    back = e.join(m, "__s", "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("__s").isNotNull(), F.struct("__p", F.coalesce("__new", "__s").alias("s"))))).alias("__a"))
    return items.drop(column).join(back, key).withColumn(column, F.array_distinct(F.transform("__a", lambda x: x["s"]))).drop("__a")


# ---- queries

@query(
    "evidence_attach_inequality",
    """with first as (select user_id, min(ts) as at from events where event_type = 'signup' group by 1)
    select e.user_id, count(*)::bigint as n, min(e.event_id) as first_event from events e join first f on f.user_id = e.user_id and f.at <= e.ts group by 1""",
)
def evidence_attach_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event attaches to its user from the first signup on."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    known = ev.where("event_type = 'signup'").groupBy(F.col("user_id").alias("slug")).agg(F.struct(F.min("ts").alias("chunk_ord")).alias("first_at"))
    return attach(ev.withColumn("chunk_ord", F.col("ts")), "user_id", known).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(
    "citation_numbering",
    """with f as (select l_orderkey, l_suppkey, l_partkey, min(l_linenumber) as first_at from lineitem group by all)
    select l_orderkey as page_id, l_suppkey as file, l_partkey as pages, (row_number() over (partition by l_orderkey order by first_at, l_suppkey, l_partkey))::int as n from f""",
)
def citation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("pages"), F.lit(0).alias("kind"), F.lit(0).alias("chunk_ord"), F.col("l_linenumber").alias("pos"))
    return number_citations(li)


@query(
    "frontmatter_sources",
    "select l_suppkey as page_id, l_returnflag as file, string_agg(distinct l_linestatus || l_linenumber, ', ' order by l_linestatus || l_linenumber) as pages from lineitem group by 1, 2",
)
def frontmatter_sources_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter_sources(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_returnflag").alias("file"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("pages")))


@query(
    "entity_first_seen",
    """select user_id as slug, arg_min(event_type, (ts, event_id)) as type, arg_min(value, (ts, event_id)) as first_value, count(*)::bigint as n_obs from events group by 1""",
)
def entity_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    obs = table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), none.alias("name"), F.col("event_type").alias("type"), none.alias("folder"), F.col("value").alias("significance"), F.col("ts").alias("chunk_ord"), F.col("event_id").alias("pos"))
    return entities(obs, spark.createDataFrame([], "slug bigint, folder string")).select("slug", "type", F.col("significance").alias("first_value"), "n_obs")


@query(
    "related_neighbours",
    """with p as (select distinct a.l_partkey as slug, b.l_partkey as other from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey)
    select slug, count(*)::bigint as n, sum(other)::bigint as total from p group by 1""",
)
def related_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order as the entities of one claim."""
    claims = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey")).alias("entities"))
    edges = spark.createDataFrame([], "subject bigint, object bigint")
    return related(edges, claims).select("slug", F.size("related").cast("bigint").alias("n"), F.aggregate("related", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("topic_rollup", "select event_type as slug, upper(event_type[1]) || event_type[2:] as title, count(*)::bigint as n_claims, min(event_id) as first_claim from events group by event_type")
def topic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.lit(0).alias("chunk_ord"), F.col("event_id").alias("pos"))
    return topic_heads(c).select("slug", "title", "n_claims", F.col("first_at.pos").alias("first_claim"))


@query(
    "first_samples",
    """with r as (select o_custkey, o_orderstatus || o_orderkey as t, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders)
    select o_custkey, string_agg(t, ' ' order by n) as samples from r where n <= 3 group by 1""",
)
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("chunk_ord"), F.col("o_orderkey").alias("pos"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("t"))
    return samples(o, "o_custkey", "t", 3).withColumn("samples", F.array_join("samples", " "))


@query("bridge_overlap", """select o.o_custkey as key, count(distinct l.l_suppkey)::bigint as n_shared from orders o join lineitem l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_suppkey group by 1""")
def bridge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in a customer's orders that are also part numbers, as the entities shared by claims and tables."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    none = F.lit("")
    mine = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key")).join(li.select("l_orderkey", "l_suppkey"), "l_orderkey").groupBy("key").agg(F.collect_set("l_suppkey").alias("entities"))
    claims = p.select(none.alias("text"), none.alias("type"), none.alias("file"), none.alias("pages"), F.lit(0).alias("chunk_ord"), F.lit(0).alias("pos"), F.array("p_partkey").alias("entities"))
    return bridge(mine, claims).select("key", F.size("shared").cast("bigint").alias("n_shared"))
