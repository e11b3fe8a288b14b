"""State from run to run: ledgers, fingerprints, differences, call logs, metrics, outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.dedup import keep_first
from folioforge.operators.registry import query
from folioforge.sources.tables import table

PASSED = ("strict", "permissive")
#: Stage aborts after so many failures in a row, or this share of failures.
STREAK, SHARE = 5, 0.10


def write_verdicts(rendered: DataFrame, disk: DataFrame, recorded: DataFrame) -> DataFrame:
    """``(path, verdict)``: write where the page is absent, has no recorded hash or is as recorded; converge where the disk has the
    rendered hash already; else conflict."""
    d, r = disk.select("path", F.col("hash").alias("d")), recorded.select("path", F.col("hash").alias("r"))
    v = F.when(F.col("d").isNull() | F.col("r").isNull() | (F.col("d") == F.col("r")), "write").when(F.col("d") == F.col("hash"), "converge").otherwise("conflict")
    return rendered.join(d, "path", "left").join(r, "path", "left").select("path", v.alias("verdict"))


def append_decisions(ledger: DataFrame, new: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger with records it doesn't have yet, and the splits that no new record takes up."""
    key = F.concat_ws("|", "concern", "action", F.array_join(F.array_sort("from"), ","), F.coalesce("into", F.lit("")))
    fresh = new.withColumn("__k", key).join(ledger.select(key.alias("__k")), "__k", "left_anti")
    fresh = keep_first(fresh, ["__k"], ["decidedAt", "signal"]).drop("__k")
    touched = fresh.select(F.explode(F.array_union("from", F.when(F.col("into").isNotNull(), F.array("into")).otherwise(F.array().cast("array<string>")))).alias("slug")).distinct()
    return ledger.unionByName(fresh, allowMissingColumns=True), splits.join(touched, "slug", "left_anti")


def upsert(state: DataFrame, new: DataFrame, present: DataFrame, key: str = "path", at: str = "synthesizedAt") -> DataFrame:
    """The latest record of each key; records whose page has vanished go, new ones stay."""
    every = state.join(present.select(key).union(new.select(key)).distinct(), key, "left_semi").withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return keep_first(every, [key], [F.desc("__new"), F.desc(at)]).drop("__new")


def known_types(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row (types): the sorted union of before(type) and now(type)."""
    return before.select("type").union(now.select("type")).where("type is not null").agg(F.array_sort(F.collect_set("type")).alias("types"))


def append_changes(log: DataFrame, new: DataFrame) -> DataFrame:
    return log.unionByName(new.join(log.select("type", "path"), ["type", "path"], "left_anti"), allowMissingColumns=True)


def to_synthesize(pages: DataFrame, state: DataFrame) -> DataFrame:
    """pages(path, data_hash, rewritten) with ``skip``: passed before on the same data, and not rewritten since."""
    s = state.where(F.col("mode").isin(*PASSED)).select("path", F.col("dataHash").alias("__h"))
    return pages.join(s, "path", "left").withColumn("skip", F.coalesce((F.col("__h") == F.col("data_hash")) & ~F.col("rewritten"), F.lit(False))).drop("__h")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, was, now, status)``: new, removed, updated or same; a full outer join."""
    b, a = before.select(key, F.col(value).alias("was")), after.select(key, F.col(value).alias("now"))
    b, a = b.withColumn("__b", F.lit(True)), a.withColumn("__a", F.lit(True))
    s = F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("updated")
    return b.join(a, key, "full").select(key, "was", "now", s.alias("status"))


def call_costs(log: DataFrame, prices: DataFrame, default_in: float, default_out: float) -> DataFrame:
    """log with ``cost``; prices(model, price_in, price_out) a million tokens, unknown models at the default."""
    p = log.join(prices, "model", "left")
    return p.withColumn("cost", T.call_cost("inputTokens", "outputTokens", F.coalesce("price_in", F.lit(default_in)), F.coalesce("price_out", F.lit(default_out)))).drop("price_in", "price_out")


def usage_since(log: DataFrame, since: str) -> DataFrame:
    """One row (calls, inputTokens, outputTokens, cost) of calls from an ISO time on, compared as text."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.where(F.col("timestamp") >= since).agg(F.count(F.lit(1)).alias("calls"), z("inputTokens"), z("outputTokens"), z("cost"))


def retry_alarm(calls: Column, repairs: Column) -> Column:
    return (repairs >= 5) | (F.when(calls > 0, repairs / calls).otherwise(F.lit(0.0)) > 0.25)


def outages(results: DataFrame, stage: str = "stage") -> DataFrame:
    """``(stage, longest, share, abort)`` of results(stage, pos, ok): the longest run of failures and their share."""
    w = Window.partitionBy(stage).orderBy("pos")
    runs = results.withColumn("run", F.sum(F.col("ok").cast("int")).over(w)).groupBy(stage, "run").agg(F.sum((~F.col("ok")).cast("int")).alias("fails"), F.count(F.lit(1)).alias("n"))
    g = runs.groupBy(stage).agg(F.max("fails").cast("bigint").alias("longest"), (F.sum("fails") / F.sum("n")).alias("share"))
    return g.withColumn("abort", (F.col("longest") >= STREAK) | (F.col("share") > SHARE))


def rolling_memory(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(slug, folder, mentionCount)``: all mentions count, repeated ones too."""
    n = mentions.groupBy("slug").agg(F.count(F.lit(1)).alias("mentionCount"))
    return entities.select("slug", "folder").join(n, "slug", "left").select("slug", "folder", F.coalesce("mentionCount", F.lit(0)).cast("bigint").alias("mentionCount"))


def run_metrics(pages: DataFrame, diff: DataFrame, claims: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: pages by type, entities by status, claims by type, usage."""
    by = lambda df, k, name: df.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(name))
    return by(pages, "type", "pagesByType").crossJoin(by(diff, "status", "entitiesByStatus")).crossJoin(by(claims, "type", "claimsByType")).crossJoin(usage)


def page_types(pages: DataFrame) -> DataFrame:
    """``(type, n)`` of pages(path, type) that say their type."""
    return pages.where("type <> ''").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def written_by_type(written: DataFrame, documents: int | Column) -> DataFrame:
    """``(type, n)`` of written(path): pages below topics/ are topics and all others entities, comparisons too, as the metrics
    have always counted them; document pages are counted by ``documents`` where there are any."""
    kind = F.when(F.substring_index("path", "/", 1) == "topics", "topic").otherwise("entity")
    one = written.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    docs = written.sparkSession.range(1).select(F.lit("document").alias("type"), (F.lit(documents) if isinstance(documents, int) else documents).cast("bigint").alias("n"))
    return one.unionByName(docs.where("n > 0"))


def entity_changes(before: DataFrame, after: DataFrame, titles: DataFrame, skipped: DataFrame) -> DataFrame:
    """``(slug, title, folder, added, status)`` of memory(slug, folder, mentionCount): new entities, and those with more mentions
    than before whose page was not skipped for a conflict."""
    b = before.select("slug", F.col("mentionCount").alias("was"))
    d = after.join(b, "slug", "left").join(skipped.select("slug").distinct().withColumn("__s", F.lit(True)), "slug", "left").join(titles.select("slug", "title"), "slug", "left")
    status = F.when(F.col("was").isNull(), "new").when((F.col("mentionCount") > F.col("was")) & F.col("__s").isNull(), "updated")
    return d.select("slug", F.coalesce("title", F.col("slug").cast("string")).alias("title"), "folder", (F.col("mentionCount") - F.coalesce("was", F.lit(0))).alias("added"), status.alias("status")).where("status is not null")


def conflict_counts(conflicts: DataFrame, since: str) -> DataFrame:
    """One row (conflictsManualEdit, conflictsPreservation) of conflicts(timestamp, type) from an ISO time on."""
    n = lambda c: F.count(F.when(c, 1))
    edit = F.coalesce(F.col("type") == "manual-edit", F.lit(False))
    return conflicts.where(F.col("timestamp") >= since).agg(n(edit).alias("conflictsManualEdit"), n(~edit).alias("conflictsPreservation"))


def full_metrics(run: str, changes: DataFrame, counters: DataFrame, written: DataFrame, usage: DataFrame, conflicts: DataFrame, ledger: DataFrame, folders_before: DataFrame, folders_after: DataFrame, issues: DataFrame, repairs: int = 0, fallbacks: int = 0, transport: int = 0, wall_ms: int = 0) -> DataFrame:
    """The run as one row. changes as of ``entity_changes``, counters as of ``ingest.extraction_counters``, written as of
    ``written_by_type``, usage as of ``usage_since``, ledger(source, status, chunks) with chunks of skipped sources,
    issues as of ``links.validation_summary``. Each part is one row, so that the cross joins are of single rows.

    No chunk counts as failed: a failed one ends the run.
    """
    n = lambda c: F.count(F.when(c, 1))
    as_map = lambda df, k: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n"))))).toDF("m")
    parts = [
        changes.agg(n(F.col("status") == "new").alias("entitiesNew"), n(F.col("status") == "updated").alias("entitiesUpdated")),
        counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}Extracted") for c in ("relationships", "claims")]),
        as_map(counters.select(F.explode("claimsByType").alias("type", "c")).groupBy("type").agg(F.sum("c").cast("bigint").alias("n")), "type").withColumnRenamed("m", "claimsByType"),
        as_map(written, "type").withColumnRenamed("m", "pagesByType"),
        usage.select(F.col("cost").alias("totalCost"), (F.col("inputTokens") + F.col("outputTokens")).alias("totalTokens")),
        conflicts,
        ledger.agg(n(F.col("status") == "new").alias("newPdfs"), F.coalesce(F.sum(F.when(F.col("status").isin("new", "changed"), F.col("chunks"))), F.lit(0)).alias("chunksProcessed"), F.coalesce(F.sum(F.when(F.col("status") == "unchanged", F.col("chunks"))), F.lit(0)).alias("chunksSkipped")),
        folders_after.join(folders_before, "folder", "left_anti").agg(F.count(F.lit(1)).alias("foldersCreated")),
        issues.agg(*[F.coalesce(F.sum(F.when(F.col("check") == c, F.col("n"))), F.lit(0)).alias(a) for c, a in (("broken links", "brokenLinks"), ("orphans", "orphanedPages"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    fixed = {"run": run, "chunksFailed": 0, "feedbackRepairs": repairs, "curationFallbacks": fallbacks, "transportFailures": transport, "wallClockMs": wall_ms}
    return out.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])


def ingest_summary(report: DataFrame) -> DataFrame:
    """One line of report(finalMode, issues)."""
    n = lambda m: F.count(F.when(F.col("finalMode") == m, 1))
    return report.agg(F.format_string("%d strict, %d permissive, %d conflicts, %d issues", n("strict"), n("permissive"), n("conflict"), F.coalesce(F.sum("issues"), F.lit(0)).cast("bigint")).alias("summary"))


# ---- queries

_PRICES = [("click", 0.8, 4.0), ("view", 0.25, 1.25), ("purchase", 3.0, 15.0)]


@query(
    "call_cost_rollup",
    """with p(model, i, o) as (values ('click', 0.8, 4.0), ('view', 0.25, 1.25), ('purchase', 3.0, 15.0)),
    c as (select event_type as model, user_id as "in", event_id % 1000 as out from events)
    select model, count(*)::bigint as calls, sum("in")::bigint as input_tokens, round(sum(("in" * coalesce(i, 1.0) + out * coalesce(o, 5.0))::double / 1e6), 6) as cost from c left join p using (model) group by model""",
)
def call_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a call log; two event types have no price of their own."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("inputTokens"), (F.col("event_id") % 1000).alias("outputTokens"))
    prices = spark.createDataFrame(_PRICES, "model string, price_in double, price_out double")
    return call_costs(log, prices, 1.0, 5.0).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("inputTokens").alias("input_tokens"), F.round(F.sum("cost"), 6).alias("cost"))


@query(
    "failure_streaks",
    """with r as (select user_id as stage, event_type <> 'error' as ok, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as run from events),
    g as (select stage, run, sum((not ok)::int) as fails, count(*) as n from r group by all)
    select stage, max(fails)::bigint as longest, sum(fails)::double / sum(n) as share, max(fails) >= 5 or sum(fails)::double / sum(n) > 0.10 as abort from g group by stage""",
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("stage"), F.struct("ts", "event_id").alias("pos"), (F.col("event_type") != "error").alias("ok"))
    return outages(ev)


@query(
    "memory_diff",
    """with b as (select user_id, count(*) as was from events where event_type <> 'signup' and ts < timestamp '2024-01-16' group by 1), a as (select user_id, count(*) as now from events where event_type <> 'error' group by 1)
    select coalesce(a.user_id, b.user_id) as user_id, was, now, case when b.user_id is null then 'new' when a.user_id is null then 'removed' when was = now then 'same' else 'updated' end as status from b full join a on a.user_id = b.user_id""",
)
def memory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    n = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return snapshot_diff(n(ev.where("event_type <> 'signup' and ts < timestamp '2024-01-16'")), n(ev.where("event_type <> 'error'")), "user_id", "n")


@query(
    "synthesis_skip",
    """select d.doc_id, coalesce(s.h = sha256(d.text) and not d.lang = 'fr', false) as skip from documents d
    left join (select doc_id, sha256(case when lang = 'de' then text || '.' else text end) as h from documents where source <> 'src1') s using (doc_id)""",
)
def synthesis_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French pages were rewritten, German ones changed, those of one source never passed."""
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("data_hash"), (F.col("lang") == "fr").alias("rewritten"))
    old = F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    state = d.select(F.col("doc_id").alias("path"), F.sha2(old, 256).alias("dataHash"), F.when(F.col("source") == "src1", "template").otherwise("strict").alias("mode"))
    return to_synthesize(pages, state).select(F.col("path").alias("doc_id"), "skip")


@query(
    "state_upsert",
    """select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order, count(*)::bigint as n from orders group by 1""",
)
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("synthesizedAt"))
    last = upsert(o.limit(0), o, o.select("path")).select(F.col("path").alias("o_custkey"), F.col("o_orderkey").alias("last_order"))
    return last.join(o.groupBy(F.col("path").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n")), "o_custkey")
