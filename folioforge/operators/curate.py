"""Curation: decision lists, their checks as error rows, merge graphs, application to aggregates, records."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.dedup import keep_first
from folioforge.operators.registry import query
from folioforge.plans.components import connected_components
from folioforge.sources.tables import table

MAX_ROWS, MAX_TOKENS, JUSTIFICATION = 250, 24_576, 120
DECISIONS = (
    "merges array<struct<`from`: array<string>, `into`: string, justification: string>>, drops array<struct<slug: string, justification: string>>,"
    " keep array<string>, unsure array<string>, pairs array<struct<`from`: string, `into`: string, verdict: string>>,"
    " clusters array<struct<members: array<string>, class: int, `into`: string, justification: string>>"
)


def parse_decisions(raw: DataFrame) -> DataFrame:
    """raw(bucket, reply) to one row a bucket with the lists of DECISIONS; members de-duplicated, justifications cut; null where it is no JSON."""
    d = raw.withColumn("d", F.from_json(T.strip_fences("reply"), DECISIONS))
    cut = lambda x: F.substring(F.coalesce(x, F.lit("")), 1, JUSTIFICATION)
    merges = F.transform("d.merges", lambda m: F.struct(F.array_distinct(m["from"]).alias("from"), m["into"].alias("into"), cut(m["justification"]).alias("justification")))
    clusters = F.transform("d.clusters", lambda m: F.struct(F.array_distinct(m["members"]).alias("members"), m["class"].alias("class"), m["into"].alias("into"), cut(m["justification"]).alias("justification")))
    return d.select("bucket", merges.alias("merges"), F.transform("d.drops", lambda x: F.struct(x["slug"].alias("slug"), cut(x["justification"]).alias("justification"))).alias("drops"), F.col("d.keep").alias("keep"), F.col("d.unsure").alias("unsure"), F.col("d.pairs").alias("pairs"), clusters.alias("clusters"))


def merge_edges(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.explode("merges").alias("m")).select(F.explode("m.from").alias("from"), F.col("m.into").alias("into"))


def decision_errors(decisions: DataFrame, candidates: DataFrame, pairs: DataFrame | None = None, never: DataFrame | None = None, entities: bool = False) -> DataFrame:
    """``(slug, error)``, one row for each violated rule: a union of anti joins and groups."""
    edges = merge_edges(decisions)
    drops = decisions.select(F.explode("drops").alias("d")).select("d.slug")
    cl = decisions.select(F.explode("clusters").alias("c")).select("c.*")
    members = cl.select(F.explode("members").alias("slug"), "into")
    kept = decisions.select(F.explode("keep").alias("slug"))
    named = edges.select(F.col("from").alias("slug")).union(edges.select("into")).union(drops).union(members.select("slug")).union(kept)
    known = candidates.select("slug").distinct()
    e = lambda df, text: df.select("slug", F.lit(text).alias("error"))
    out = e(named.distinct().join(known, "slug", "left_anti"), "unknown slug")
    out = out.unionByName(e(edges.where("`from` = `into`").select(F.col("into").alias("slug")), "merged into itself"))
    judged = edges.select(F.col("from").alias("slug"), F.lit("merge").alias("k")).union(drops.withColumn("k", F.lit("drop"))).union(members.select("slug", F.lit("cluster"))).union(kept.withColumn("k", F.lit("keep")))
    out = out.unionByName(e(judged.distinct().groupBy("slug").count().where("count > 1"), "judged twice"))
    out = out.unionByName(e(members.groupBy("slug").count().where("count > 1"), "in two clusters"))
    out = out.unionByName(e(edges.select(F.col("into").alias("slug")).distinct().join(drops, "slug", "left_semi"), "survivor is dropped"))
    out = out.unionByName(e(edges.groupBy(F.col("from").alias("slug")).agg(F.countDistinct("into").alias("n")).where("n > 1"), "merged into two"))
    out = out.unionByName(e(cl.where(~F.size("members").between(2, 4)).select(F.col("into").alias("slug")), "cluster needs 2 to 4 members"))
    out = out.unionByName(e(cl.where(~F.coalesce(F.col("class").between(1, 5), F.lit(False))).select(F.col("into").alias("slug")), "cluster class is 1 to 5"))
    out = out.unionByName(e(cl.where((F.col("class") == 3) & (F.size(F.filter("members", lambda m: T.indicator(m).isNotNull())) != 1)).select(F.col("into").alias("slug")), "class 3 has exactly one indicator"))
    out = out.unionByName(e(cl.where((F.col("class") == 5) & (F.size(F.array_distinct(F.transform("members", lambda m: T.region_form(m)["core"]))) != 1)).select(F.col("into").alias("slug")), "class 5 has one stem"))
    if entities:
        out = out.unionByName(e(drops, "entities are merged, not dropped"))
    if pairs is not None:
        verdicts = decisions.select(F.explode("pairs").alias("p")).select("p.*").select(F.least("from", "into").alias("a"), F.greatest("from", "into").alias("b"))
        asked = pairs.select(F.least("from", "into").alias("a"), F.greatest("from", "into").alias("b"))
        out = out.unionByName(e(asked.join(verdicts, ["a", "b"], "left_anti").select(F.col("a").alias("slug")), "proposed pair is not judged"))
    if never is not None:
        n = never.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        both = cl.select("into", F.explode("members").alias("x"), "members").select("into", "x", F.explode("members").alias("y")).where("x < y")
        out = out.unionByName(e(both.join(n, ["x", "y"]).select(F.col("into").alias("slug")), "never pair in a cluster"))
    return out


def collapse(edges: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """``merges(old, new)`` and ``rejected(component, reason)`` of edges(from, into).

    Each component's survivor is its only node that is merged into and never away. Without exactly one the component is
    rejected; with ``lenient`` (decisions carried over from earlier runs) its greatest slug survives instead.
    """
    part = connected_components(edges, "from", "into")
    away = edges.select(F.col("from").alias("node")).distinct().withColumn("away", F.lit(True))
    top = edges.select(F.col("into").alias("node")).distinct().withColumn("top", F.lit(True))
    m = part.join(away.hint("merge"), "node", "left").join(top.hint("merge"), "node", "left")
    lead = F.when(F.col("top") & F.col("away").isNull(), F.col("node"))
    g = m.groupBy("component").agg(F.count(lead).alias("n"), F.min(lead).alias("lead"), F.max("node").alias("last"))
    new = F.when(F.col("n") == 1, F.col("lead")).when(F.lit(lenient), F.col("last"))
    chosen = g.select("component", new.alias("new"))
    merges = part.join(chosen.where("new is not null"), "component").where("node <> new").select(F.col("node").alias("old"), "new")
    return merges, chosen.where("new is null").select("component", F.lit("no unique survivor").alias("reason"))


def active_records(records: DataFrame, splits: DataFrame, never: DataFrame) -> DataFrame:
    """records(id, concern, action, from, into): those no split touches, and no merge or cluster of a never pair."""
    every = records.withColumn("every", F.array_union("from", F.when(F.col("into").isNotNull(), F.array("into")).otherwise(F.array().cast("array<string>"))))
    s = every.select("id", F.explode("every").alias("slug")).join(splits.select("slug"), "slug").select("id").distinct()
    n = never.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    pairs = every.where("action in ('merge', 'cluster')").select("id", F.explode("every").alias("x"), "every").select("id", "x", F.explode("every").alias("y")).where("x < y")
    return records.join(s, "id", "left_anti").join(pairs.join(n, ["x", "y"]).select("id").distinct(), "id", "left_anti")


def vetoed_by_edits(edges: DataFrame, disk: DataFrame) -> DataFrame:
    """edges(from, into) whose source page was edited by hand: disk(slug, hash, recorded) with no or another recorded hash."""
    edited = disk.where(~F.col("hash").eqNullSafe(F.col("recorded"))).select(F.col("slug").alias("from"))
    return edges.join(edited, "from", "left_semi")


def drops_vetoed(drops: DataFrame, disk: DataFrame) -> DataFrame:
    """drops(slug) whose page was edited by hand; disk as in ``vetoed_by_edits``."""
    return drops.join(disk.where(~F.col("hash").eqNullSafe(F.col("recorded"))).select("slug"), "slug", "left_semi")


def clusters_vetoed(clusters: DataFrame, disk: DataFrame) -> DataFrame:
    """clusters(members, ...) of which one member's page was edited by hand: the whole cluster is off."""
    edited = disk.where(~F.col("hash").eqNullSafe(F.col("recorded"))).select("slug")
    hit = clusters.select("members", F.explode("members").alias("slug")).join(edited, "slug", "left_semi")
    return clusters.join(hit.select("members").distinct(), "members", "left_semi")


def merge_topics(claims: DataFrame, merges: DataFrame) -> DataFrame:
    """claims(slug, text, chunk_ord, pos): absorbed claims join the survivor's, without texts it has; its own all stay."""
    m = claims.join(merges.select(F.col("old").alias("slug"), "new"), "slug", "left").withColumn("own", F.col("new").isNull()).withColumn("slug", F.coalesce("new", "slug")).drop("new")
    w = Window.partitionBy("slug", "text").orderBy(F.desc("own"), "chunk_ord", "pos")
    return m.withColumn("rn", F.row_number().over(w)).where("own or rn = 1").drop("rn", "own")


def drop_topics(claims: DataFrame, drops: DataFrame) -> DataFrame:
    return claims.join(drops.select("slug"), "slug", "left_anti")


def apply_clusters(entities: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that stay, and members(into, pos, slug), of clusters(members, into, at); of several for one ``into`` the first
    decided, the least ``at``."""
    first = keep_first(clusters.withColumn("k", F.array_join("members", " ")), ["into"], ["at", "k"]).drop("k")
    members = first.select("into", F.posexplode("members").alias("pos", "slug"))
    return entities.join(members.select("slug").distinct(), "slug", "left_anti"), members


def survivors(candidates: DataFrame, merges: DataFrame, drops: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """candidates(slug, n, samples, on_disk) that remain, with the counts and first samples of what they absorb."""
    alive = candidates.join(drops.select("slug"), "slug", "left_anti").join(members.select("slug").distinct(), "slug", "left_anti")
    m = alive.join(merges.select(F.col("old").alias("slug"), "new"), "slug", "left").withColumn("own", F.col("new").isNull()).withColumn("into", F.coalesce("new", "slug"))
    one = F.struct((~F.col("own")).alias("o"), "slug", "samples")
    g = m.groupBy("into").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(one)).alias("s"), F.bool_or("on_disk").alias("on_disk"))
    return g.select(F.col("into").alias("slug"), "n", F.slice(F.flatten(F.transform("s", lambda x: x["samples"])), 1, k).alias("samples"), "on_disk")


def compose_rounds(first: DataFrame, second: DataFrame, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges (old, new) of two rounds, the second judging the survivors of the first, as one set of merges, and all drops.

    Components go to the survivor of the last round; where that is dropped, all that it absorbed is dropped with it.
    """
    e = first.select(F.col("old").alias("from"), F.col("new").alias("into")).union(second.select("old", "new"))
    merges, _ = collapse(e, lenient=True)
    gone = drops.select("slug").distinct()
    lost = merges.join(gone.select(F.col("slug").alias("new")), "new", "left_semi")
    return merges.join(gone.select(F.col("slug").alias("new")), "new", "left_anti").select("old", "new"), gone.union(lost.select("old")).distinct()


def denials(proposed: DataFrame, judged: DataFrame) -> DataFrame:
    """proposed(from, into) that judged(from, into, verdict) doesn't confirm; what is not judged is denied."""
    j = judged.select(F.least("from", "into").alias("a"), F.greatest("from", "into").alias("b"), "verdict")
    p = proposed.withColumn("a", F.least("from", "into")).withColumn("b", F.greatest("from", "into"))
    return p.join(j, ["a", "b"], "left").where(F.coalesce("verdict", F.lit("deny")) != "confirm").select("from", "into")


def chain(*maps: DataFrame) -> DataFrame:
    """``(old, new)`` of maps(old, new) that are applied one after another."""
    out = maps[0].select("old", "new")
    for m in maps[1:]:
        step = m.select(F.col("old").alias("new"), F.col("new").alias("__n"))
        went = out.join(step, "new", "left").select("old", F.coalesce("__n", "new").alias("new"))
        out = went.unionByName(m.select("old", "new").join(out.select("old"), "old", "left_anti"))
    return out.where("old <> new")


@dataclass
class Stages:
    """What ``apply_in_order`` gives: ``remap(old, new)`` of all stages, the candidates before and after the automatic merges, what
    the judge was asked, and the evidence as it is at last, with the members of clusters."""

    remap: DataFrame
    before: DataFrame
    candidates: DataFrame
    proposed: DataFrame
    asked: DataFrame
    evidence: DataFrame
    members: DataFrame


def apply_in_order(evidence: DataFrame, build: Callable, sticky: DataFrame, sticky_clusters: DataFrame, find: Callable, judge: Callable, disk: DataFrame | None = None) -> Stages:
    """Recorded merges first, then automatic ones on the candidates that leaves, then the judge's on candidates made anew, then clusters.

    evidence(slug, ...); ``build(evidence)`` gives candidates(slug, ...), ``find(candidates)`` gives pairs(from, into, signal, tier)
    and clusters(members, class, into, signal, ...), ``judge(open, pairs, clusters)`` gives merges(from, into) and clusters(members,
    into). sticky(from, into) and sticky_clusters(members, into, at) are records of earlier runs. Members of recorded clusters
    are no candidates. With disk(slug, hash, recorded), merges of pages and clusters with members that were edited by hand are off.
    """
    keep = lambda e: e if disk is None else e.join(vetoed_by_edits(e, disk).select("from", "into"), ["from", "into"], "left_anti")
    whole = lambda c: c if disk is None else c.join(clusters_vetoed(c, disk).select("members"), "members", "left_anti")
    into = lambda e, m: e.join(m.select(F.col("old").alias("slug"), F.col("new").alias("__new")), "slug", "left").withColumn("slug", F.coalesce("__new", "slug")).drop("__new")
    first, _ = collapse(keep(sticky), lenient=True)
    old_clusters = whole(sticky_clusters).select("members", "into", F.struct(F.lit(0).alias("stage"), F.col("at")).alias("at"))
    held = old_clusters.select(F.explode("members").alias("slug")).distinct()
    now = into(evidence, first)
    before = build(now).join(held, "slug", "left_anti")
    pairs, clusters = find(before)
    second, _ = collapse(keep(pairs.where("tier = 'auto'").select("from", "into")), lenient=True)
    now = into(now, second)
    cands = build(now).join(held, "slug", "left_anti")
    proposed, asked_clusters = still_present(pairs.where("tier = 'proposed'"), cands), clusters_present(clusters, cands)
    asked = open_candidates(cands, proposed, asked_clusters)
    merges, decided = judge(asked, proposed, asked_clusters)
    third, _ = collapse(keep(merges.select("from", "into")))
    now = into(now, third)
    new_clusters = whole(decided).select("members", "into", F.struct(F.lit(1).alias("stage"), F.concat_ws(" ", "members").alias("at")).alias("at"))
    rest, members = apply_clusters(now, old_clusters.withColumn("at", F.struct("at.stage", F.col("at.at").cast("string").alias("at"))).unionByName(new_clusters))
    remap = chain(first, second, third, members.where("slug <> `into`").select(F.col("slug").alias("old"), F.col("into").alias("new")).distinct())
    return Stages(remap, before, cands, proposed, asked, rest, members)


def open_candidates(candidates: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """What no pair or cluster touches: only that goes to the expensive judge."""
    busy = pairs.select(F.col("from").alias("slug")).union(pairs.select("into")).union(clusters.select(F.explode("members")))
    return candidates.join(busy.distinct(), "slug", "left_anti")


def still_present(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    s = candidates.select("slug").distinct()
    return pairs.join(s.withColumnRenamed("slug", "from"), "from", "left_semi").join(s.withColumnRenamed("slug", "into"), "into", "left_semi")


def clusters_present(clusters: DataFrame, candidates: DataFrame) -> DataFrame:
    """clusters(members, ...) of which every member is still a candidate."""
    gone = clusters.select("members", F.explode("members").alias("slug")).join(candidates.select("slug").distinct(), "slug", "left_anti")
    return clusters.join(gone.select("members").distinct(), "members", "left_anti")


def decision_records(merges: DataFrame, pairs: DataFrame, concern: str, run_id: str, decided_at: str, drops: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """A record for each merge(old, new), drop(slug) and cluster(members, into, signal, class). A merge's signal is that of the
    pair that proposed it, else 'model'; a cluster's ``from`` are its members but the one that leads."""
    sig = pairs.groupBy(F.col("from").alias("old"), F.col("into").alias("new")).agg(F.min("signal").alias("signal"))
    none = F.lit(None)
    out = merges.join(sig, ["old", "new"], "left").select(F.lit("merge").alias("action"), F.array("old").alias("from"), F.col("new").alias("into"), F.coalesce("signal", F.lit("model")).alias("signal"), none.cast("int").alias("class"))
    if drops is not None:
        out = out.unionByName(drops.select(F.lit("drop").alias("action"), F.array("slug").alias("from"), none.cast("string").alias("into"), F.lit("model").alias("signal"), none.cast("int").alias("class")))
    if clusters is not None:
        out = out.unionByName(clusters.select(F.lit("cluster").alias("action"), F.array_sort(F.filter("members", lambda m: m != F.col("into"))).alias("from"), "into", "signal", "class"))
    return out.select(F.lit(concern).alias("concern"), "*", F.lit(decided_at).alias("decidedAt"), F.lit(run_id).alias("runId"))


def deletions(pages: DataFrame, merges: DataFrame, drops: DataFrame, members: DataFrame) -> DataFrame:
    """pages(path, slug) that go."""
    gone = merges.select(F.col("old").alias("slug")).union(drops.select("slug")).union(members.where("slug <> `into`").select("slug")).distinct()
    return pages.join(gone, "slug", "left_semi")


def emptied_folders(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Folders, and their ancestors, that hold no page any more."""
    def folders(df: DataFrame) -> DataFrame:
        parts = F.split(T.folder_of("path"), "/")
        return df.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder")).where("folder <> ''").distinct()

    return folders(gone).join(folders(pages.join(gone.select("path"), "path", "left_anti")), "folder", "left_anti")


def pack(slugs: Iterable[str], linked: dict[str, str] | None = None, max_rows: int = MAX_ROWS, max_tokens: int = MAX_TOKENS) -> list[list[str]]:
    """Slugs sorted by stem into buckets, closed at ``max_rows`` rows or ``max_tokens`` estimated tokens; slugs of one proposal
    component (``linked``: slug to component) keep together."""
    linked = linked or {}
    stem = _stem
    lead = {c: min(stem(s) for s in g) for c, g in ((c, list(g)) for c, g in groupby(sorted(linked, key=linked.get), key=linked.get))}
    order = sorted(slugs, key=lambda s: (lead.get(linked.get(s), stem(s)), linked.get(s, ""), stem(s), s))
    out: list[list[str]] = []
    size = 0
    for s in order:
        cost = len(s) + 64
        if not out or len(out[-1]) >= max_rows or -(-size // 4) >= max_tokens:
            out.append([])
            size = 0
        out[-1].append(s)
        size += cost
    return out


def _stem(slug: str) -> str:
    parts = [p[:-1] if len(p) > 3 and p.endswith("s") else p for p in slug.lower().split("-")]
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    return "-".join(parts)


def buckets(candidates: DataFrame, max_rows: int = MAX_ROWS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(concern, slug, bucket)`` of candidates(concern, slug, component): packing restarts its sum at each bucket, which no
    window can, so each concern is packed in Python."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = {s: c for s, c in zip(pdf["slug"], pdf["component"]) if c is not None and not pd.isna(c)}
        rows = [(pdf["concern"].iloc[0], s, k) for k, b in enumerate(pack(pdf["slug"], linked, max_rows, max_tokens)) for s in b]
        return pd.DataFrame(rows, columns=["concern", "slug", "bucket"])

    return candidates.groupBy("concern").applyInPandas(run, "concern string, slug string, bucket int")


# ---- queries

@query(
    "connected_components",
    """with recursive g as (select doc_id, min(doc_id) over (partition by text) as head from documents), e as (select distinct doc_id as u, head as v from g where doc_id <> head
      union select distinct head, doc_id from g where doc_id <> head), r as (select u as node, u as seen from e union select r.node, e.v from r join e on e.u = r.seen)
    select node, min(seen) as component from r group by node""",
)
def components_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    chain = docs.withColumn("prev", F.lag("doc_id").over(Window.partitionBy("t").orderBy("doc_id"))).where("prev is not null")
    return connected_components(chain, "prev", "doc_id")


@query(
    "topic_merge_claims",
    """with c as (select case when event_type = 'view' then 'click' else event_type end as slug, event_type <> 'view' as own, value::varchar as text, event_id from events)
    select slug, text, event_id from c qualify own or row_number() over (partition by slug, text order by own desc, event_id) = 1""",
)
def topic_merge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views merge into clicks; values are the claims' texts."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("slug"), F.col("value").alias("text"), F.col("event_id").alias("pos"), F.lit(0).alias("chunk_ord"))
    merges = spark.createDataFrame([("view", "click")], "old string, new string")
    return merge_topics(ev, merges).select("slug", F.col("text").cast("string").alias("text"), F.col("pos").alias("event_id"))
