"""Chat formatting with quotation linking.

Lines of a message that start with ``>`` quote an earlier one, ``>>`` or ``> >`` one more level up. Each run of lines of one
level is a quoted passage. Its normalised text is hashed and joined, inside the conversation, to the hashes of the messages'
own words (a whole message, each of its paragraphs, each of its lines); a passage that is none of these is looked up by
the hashes of its lines, as consecutive lines of one message. The message so found is the one replied to; the
conversation is put in reply order, replies after what they reply to, and the quotes are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import same, table
from folioforge.plans.lineage import shared_table

#: The quote marks at the start of a line.
MARKS = r"^[ \t]*(>[ \t]*)+"
#: "... wrote:" lines that mail programs put before a quote; they belong to it.
ATTRIBUTION = r"(?i)^.*\b(wrote|schrieb|écrit|escribió)[^\n]{0,20}:[ \t]*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \t\r\n]+", " "))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(normal(text)))


def quote_level(line: Column) -> Column:
    return F.regexp_count(F.regexp_substr(line, F.lit(MARKS)), F.lit(">"))


def parse(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` with ``own`` (text without quotes) and ``quotes``: array of (level, ord, text), the passages in order."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.coalesce(quote_level(x), F.lit(0)).alias("level"), x.alias("line")))
    out = messages.withColumn("__lines", F.when(F.col("text").contains(">"), lines))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        body = F.regexp_replace(x["line"], MARKS, "")
        run = F.when(x["level"] == 0, x["line"]).otherwise(body)
        joined = F.struct(x["level"].alias("level"), F.concat(last["text"], F.lit("\n"), run).alias("text"))
        begun = F.struct(x["level"].alias("level"), run.alias("text"))
        same_run = (F.size(acc) > 0) & (last["level"] == x["level"])
        return F.when(same_run, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(begun)))

    runs = F.aggregate("__lines", F.array().cast("array<struct<level: int, text: string>>"), step)
    out = out.withColumn("__runs", runs)
    own = F.array_join(F.filter(F.split(F.array_join(F.transform(F.filter("__runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n"), "\n", -1), lambda x: ~x.rlike(ATTRIBUTION)), "\n")
    out = out.withColumn("own", F.when(F.col("__runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(own))
    passages = F.transform(F.filter("__runs", lambda r: r["level"] > 0), lambda r, i: F.struct(r["level"].alias("level"), i.alias("ord"), r["text"].alias("text")))
    return out.withColumn("quotes", passages).withColumn("own", F.trim(F.regexp_replace("own", r"\A\s+|\s+\z", ""))).drop("__lines", "__runs")


def _lines(text: Column) -> Column:
    """The lines with anything on them."""
    return F.filter(F.split(text, "\n", -1), lambda x: normal(x) != "")


def line_runs(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """wanted(conv_id, turn, level, ord, quote) whose lines, two or more, follow each other in an earlier own(conv_id, source, own): with that ``source``.

    Blank lines don't count on either side.
    """
    asked = wanted.withColumn("lines", _lines(F.col("quote"))).withColumn("n", F.size("lines")).where("n > 1").distinct()
    asked = asked.select("conv_id", "turn", "level", "ord", F.md5("quote").alias("quote"), "n", F.posexplode("lines").alias("i", "line")).withColumn("digest", _digest(F.col("line"))).drop("line")
    held = own.distinct().select("conv_id", "source", F.md5("own").alias("own"), F.posexplode(_lines(F.col("own"))).alias("p", "line")).withColumn("digest", _digest(F.col("line"))).drop("line")
    met = asked.join(held, ["conv_id", "digest"]).where("source < turn")
    # the lines of one occurrence are all moved by as much; md5 of the texts tells different rows of one turn apart
    runs = met.groupBy("conv_id", "turn", "level", "ord", "quote", "n", "source", "own", (F.col("p") - F.col("i")).alias("shift")).agg(F.count(F.lit(1)).alias("found"))
    return runs.where("found = n").select("conv_id", "turn", "level", "ord", "source")


def link(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent)``: the message that a message quotes.

    The passage of the lowest level decides, then the first in the message; of several originals the latest earlier one.
    Lines out of a message are looked for where no whole message, paragraph or line is the passage.
    """
    passages = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q"))
    wanted = passages.select("conv_id", "turn", F.col("q.level").alias("level"), F.col("q.ord").alias("ord"), F.col("q.text").alias("quote")).where(normal(F.col("quote")) != "")
    wanted = shared_table(wanted.withColumn("digest", _digest(F.col("quote"))), "quotes")
    asked = wanted.select("conv_id").distinct()
    own = shared_table(parsed.join(asked, "conv_id", "left_semi").select("conv_id", F.col("turn").alias("source"), "own"), "quoted")
    texts = F.concat(F.array("own"), F.split("own", "\n[ \t]*\n"), F.split("own", "\n"))
    units = own.select("conv_id", "source", F.explode(F.array_distinct(F.filter(texts, lambda x: normal(x) != ""))).alias("unit"))
    units = units.select("conv_id", "source", _digest(F.col("unit")).alias("digest"))
    hits = shared_table(wanted.join(units, ["conv_id", "digest"]).where("source < turn").select("conv_id", "turn", "level", "ord", "digest", "source"), "hits")
    rest = wanted.join(hits, ["conv_id", "turn", "level", "ord", "digest"], "left_anti").drop("digest")
    hits = hits.drop("digest").unionByName(line_runs(rest, own))
    w = Window.partitionBy("conv_id", "turn").orderBy("level", "ord", F.desc("source"))
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conv_id", "turn", F.col("source").alias("parent"))


def _thread(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depth-first order: a message's replies after it, by turn."""
    pdf = pdf.sort_values(["turn", "role", "own"], kind="stable", na_position="first").reset_index(drop=True)
    first: dict = {}
    for i, t in enumerate(pdf["turn"].tolist()):
        first.setdefault(t, i)
    children: dict[int, list[int]] = {}
    roots = []
    for i, p in enumerate(pdf["parent"].tolist()):
        (roots if pd.isna(p) or int(p) not in first else children.setdefault(first[int(p)], [])).append(i)
    order, todo, depth = [], [(i, 0) for i in reversed(roots)], {}
    while todo:
        i, d = todo.pop()
        depth[i] = d
        order.append(i)
        todo += [(j, d + 1) for j in reversed(children.get(i, []))]
    pdf["depth"] = pd.Series(depth).reindex(range(len(pdf))).astype("int32")
    place = {i: k for k, i in enumerate(order)}
    pdf["place"] = [place[i] for i in range(len(pdf))]
    return pdf[["conv_id", "turn", "role", "own", "parent", "depth", "place"]]


def conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, n_messages, n_links, chat)``: each conversation in reply order; ``chat`` is an array of
    (turn, role, parent, depth, text), without quotes.

    A message without a quote that is found has no parent and starts a thread; threads go by turn. A message of quotes
    only keeps its place with an empty text. Null text counts as empty, null role stays null; rows without conv_id or
    turn take no part. Repeated rows count once; different rows of one turn all stay, the first by role and text being
    the one that is replied to. Texts may be of any length; further columns are not looked at; an empty table gives an
    empty result.
    """
    kinds = dict(messages.dtypes)
    rows = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").where("conv_id is not null and turn is not null").distinct()
    parsed = parse(rows)
    links = link(parsed)
    one = parsed.select("conv_id", "turn", "role", "own")
    joined = one.join(links, ["conv_id", "turn"], "left")
    linked = links.select("conv_id").distinct()
    # only conversations with a link need their order worked out
    schema = f"conv_id {kinds['conv_id']}, turn bigint, role {kinds['role']}, own string, parent bigint, depth int, place bigint"
    threaded = joined.join(linked, "conv_id", "left_semi").groupBy("conv_id").applyInPandas(_thread, schema)
    plain = joined.join(linked, "conv_id", "left_anti").select("conv_id", "turn", "role", "own", "parent", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("place"))
    item = F.struct("place", "turn", "role", F.col("own").alias("text"), "parent", "depth")
    grouped = threaded.unionByName(plain).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    chat = F.transform("m", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["parent"].alias("parent"), x["depth"].alias("depth"), x["text"].alias("text")))
    return grouped.select("conv_id", F.size("m").cast("bigint").alias("n_messages"), F.size(F.filter("m", lambda x: x["parent"].isNotNull())).cast("bigint").alias("n_links"), chat.alias("chat"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as one text each, a line "role: text" for each message."""
    out = conversations(table(spark, sf_dir, "conversations"))
    text = F.array_join(F.transform("chat", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), x["text"])), "\n")
    return out.select("conv_id", "n_messages", "n_links", text.alias("chat"), F.array_join(F.transform("chat", lambda x: x["turn"].cast("string")), ",").alias("turns"))


_N = "trim(regexp_replace(lower({}), '[ \t\r\n]+', ' ', 'g'), ' ')"
ORACLE = rf"""
with recursive m as (select distinct conv_id, turn::bigint as turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
l as (select conv_id, turn, role, i, line, len(regexp_extract_all(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '>')) as level
      from (select conv_id, turn, role, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from m)),
f as (select *, case when level = lag(level) over w then 0 else 1 end as new from l window w as (partition by conv_id, turn, role order by i)),
r as (select *, sum(new) over (partition by conv_id, turn, role order by i) as run from f),
p as (select conv_id, turn, level, run, string_agg(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), chr(10) order by i) as text from r where level > 0 group by all),
o as (select conv_id, turn, role, trim(coalesce(string_agg(line, chr(10) order by i) filter (where level = 0 and not
        (regexp_matches(line, '(?i)^.*\b(wrote|schrieb|écrit|escribió)[^\n]{{0,20}}:[ \t]*$') and contains_quote)), ''), chr(10) || chr(9) || chr(13) || ' ') as own
      from (select *, max(contains(line, '>')::int) over (partition by conv_id, turn, role) = 1 as contains_quote from l) group by all),
u as (select distinct conv_id, turn as source, {_N.format('unit')} as unit from (
        select conv_id, turn, own as unit from o union all select conv_id, turn, unnest(regexp_split_to_array(own, '\n[ \t]*\n')) from o
        union all select conv_id, turn, unnest(string_split(own, chr(10))) from o)),
k as (select p.conv_id, p.turn, u.source as parent from p join u on u.conv_id = p.conv_id and u.source < p.turn and u.unit <> '' and u.unit = {_N.format('p.text')}
      qualify row_number() over (partition by p.conv_id, p.turn order by p.level, p.run, u.source desc) = 1),
j as (select o.*, k.parent from o left join k using (conv_id, turn)),
t as (select conv_id, turn, role, own, parent, [turn] as path from j where parent is null
      union all select j.conv_id, j.turn, j.role, j.own, j.parent, list_append(t.path, j.turn) from j join t on t.conv_id = j.conv_id and t.turn = j.parent)
select conv_id, count(*)::bigint as n_messages, count(parent)::bigint as n_links,
       string_agg(coalesce(role, '') || ': ' || own, chr(10) order by path, role, own) as chat, string_agg(turn::varchar, ',' order by path, role, own) as turns
from t group by conv_id"""

QUERIES = {"op4_chat": op4_chat}
ORACLES = {"op4_chat": ORACLE}
