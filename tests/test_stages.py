import os

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import aggregate, curate, ingest, links, render, resolve, state
from folioforge.operators.catalog import ORACLES, QUERIES
from folioforge.plans import seams
from folioforge.sources import sinks
from tests.conftest import DATA
from tests.oracle import check
from tests.test_operators import cands, pairs, rows

E = "`from` string, `into` string"


def test_abbreviation_as_introduced(spark):
    c = cands(spark, "hac", "hospital-care", "dkr", "dansk-kvalitets-register", "register-for-hjerte", "rfh", "lpr", "data-fra-landspatientregister", "landspatientregister")
    text = lambda t: [p[:2] for p in pairs(resolve.detect(c, "da", spark.createDataFrame([(t,)], "text string"))[0]) if p[2] == "abbreviation"]
    assert text("the Hospital Care (Hac)") == []
    assert text("Dansk Kvalitets\nRegister (DKR)") == [("dkr", "dansk-kvalitets-register")]
    assert text("Register for Hjerte (RFH)") == [("rfh", "register-for-hjerte")]
    assert text("Data fra Landspatientregister (LPR)") == [("lpr", "landspatientregister")]
    assert text("One Two Three Four Five Six Dansk Kvalitets Register (DKR)") == []


def test_initials_are_letters_and_glossary_survivor(spark):
    found = lambda *s: [p[:3] for p in pairs(resolve.detect(cands(spark, *s), "da")[0]) if p[2] == "initials"]
    assert found("registry-2", "registry-2024") == []
    assert found("hansen-m-h", "hansen-morten-h") == [("hansen-morten-h", "hansen-m-h", "initials")]
    assert found("hospital-nord", "hospital-syd", "hospital-n") == [("hospital-n", "hospital-nord", "initials")]
    t = spark.createDataFrame([(0, "blødning", "aaaa-longer", "da"), (0, "bleeding", "bleeding", "en")], "group int, term string, slug string, lang string")
    into = lambda lang: [p[1] for p in pairs(resolve.detect(cands(spark, "aaaa-longer", "bleeding"), lang, terms=t)[0])]
    assert (into("de"), into("da"), into("en")) == (["bleeding"], ["aaaa-longer"], ["bleeding"])
    g = resolve.glossary_terms(spark)
    assert g.count() == 60 and g.where("slug = 'iskaemisk-apopleksi' and lang = 'da'").count() == 1


def test_subsequence_blocks_of_two_tokens(spark):
    found = lambda *s: [p[:2] for p in pairs(resolve.detect(cands(spark, *s), "en")[0]) if p[2] == "subsequence"]
    assert found("a-x-b-y-c", "a-b-c", "x-y") == [("a-x-b-y-c", "a-b-c"), ("a-x-b-y-c", "x-y")]
    assert found("b-a", "a-c-b") == [] and found("heart-care", "heart-hospital-care") == [] and found("a-a", "a-b-a") == [("a-b-a", "a-a")]


def test_first_cluster_decided_stays(spark):
    known = spark.createDataFrame([(x,) for x in "abyzq"], "slug string")
    c = spark.createDataFrame([(["z", "y"], "i", 1), (["a", "b"], "i", 2)], "members array<string>, `into` string, at int")
    stay, members = curate.apply_clusters(known, c)
    assert rows(stay) == [("a",), ("b",), ("q",)] and rows(members) == [("i", 0, "z"), ("i", 1, "y")]


def test_order_of_application(spark):
    ev = spark.createDataFrame([(x, 1) for x in ("s1", "s2", "auto-a", "auto-b", "pa", "pb", "c1", "c2", "open")], "slug string, n int")
    build = lambda e: e.groupBy("slug").agg(F.sum("n").alias("n"))
    df = lambda schema, *x: spark.createDataFrame(list(x), schema)
    seen = {}

    def find(c):
        seen["found"] = [r.slug for r in c.orderBy("slug").collect()]
        return df(E + ", signal string, tier string", ("auto-a", "auto-b", "alias", "auto"), ("pa", "pb", "initials", "proposed"), ("s1", "open", "initials", "proposed")), df("members array<string>, class int, `into` string, signal string", (["c1", "c2"], 5, "c1", "region-form"))

    def judge(o, p, c):
        seen["asked"] = [r.slug for r in o.orderBy("slug").collect()], rows(p.select("from", "into")), [r["members"] for r in c.collect()]
        return df(E, ("pa", "pb")), c.select("members", "into")

    none = df("members array<string>, `into` string, at int")
    st = curate.apply_in_order(ev, build, df(E, ("s1", "s2")), none, find, judge)
    assert seen["found"] == ["auto-a", "auto-b", "c1", "c2", "open", "pa", "pb", "s2"]
    assert seen["asked"] == (["auto-b", "open", "s2"], [("pa", "pb")], [["c1", "c2"]])
    assert rows(st.remap) == [("auto-a", "auto-b"), ("c2", "c1"), ("pa", "pb"), ("s1", "s2")]
    assert rows(st.evidence) == [("auto-b", 1), ("auto-b", 1), ("open", 1), ("pb", 1), ("pb", 1), ("s2", 1), ("s2", 1)]
    edited = df("slug string, hash string, recorded string", ("pa", "x", "y"), ("c2", "x", None), ("open", "x", "x"))
    st = curate.apply_in_order(ev, build, df(E, ("s1", "s2")), none, find, judge, edited)
    assert rows(st.remap) == [("auto-a", "auto-b"), ("s1", "s2")] and st.members.count() == 0


def test_chained_maps(spark):
    m = lambda *x: spark.createDataFrame(list(x), "old string, new string")
    assert rows(curate.chain(m(("a", "b"), ("x", "y")), m(("b", "c"), ("p", "q")), m(("c", "d")))) == [("a", "d"), ("b", "d"), ("c", "d"), ("p", "q"), ("x", "y")]


def test_merged_entities(spark):
    known = spark.createDataFrame([("a", "A", "t", "f", "s", ["al"], (1, 0), 2), ("b", "B", "u", "g", "r", [], (2, 0), 1), ("c", "C", "u", "g", "r", [], (3, 0), 1)], "slug string, name string, type string, folder string, significance string, aliases array<string>, first_at struct<chunk_ord int, pos int>, n_obs bigint")
    merges = spark.createDataFrame([("a", "b"), ("x", "b"), ("c", "new")], "old string, new string")
    disk = spark.createDataFrame([("x", "Ex", "t", "d")], "slug string, title string, type string, folder string")
    got = {r.slug: (r.name, r.type, r.folder, r.aliases, r.n_obs) for r in aggregate.merge_entities(known, merges, disk).collect()}
    assert got == {"b": ("B", "u", "g", ["al", "A", "Ex"], 3), "new": ("New", "unknown", "entities", ["C"], 1)}


def test_collation_of_titles(spark):
    t = spark.createDataFrame([(x,) for x in ("B", "a", "å", "A", "b")], "title string")
    assert [r.title for r in aggregate.by_title(t).collect()] == ["a", "A", "å", "b", "B"]


def test_mirrored_edges_in_a_composite(spark):
    s = "`into` string, slug string, subject string, object string, predicate string, page int, file string, pages string"
    inc = spark.createDataFrame([("i", "a", "b", "a", "p", 1, "f", "1"), ("i", "a", "z", "a", "p", 1, "f", "1")], s)
    out = spark.createDataFrame([("i", "b", "b", "a", "p", 1, "f", "1"), ("j", "z", "z", "a", "p", 1, "f", "1")], s)
    assert [r.subject for r in aggregate.without_member_edges(inc, out).collect()] == ["z"]


def test_records_and_vetoes(spark):
    merges = spark.createDataFrame([("a", "b"), ("c", "b")], "old string, new string")
    found = spark.createDataFrame([("a", "b", "alias")], E + ", signal string")
    drops = spark.createDataFrame([("d",)], "slug string")
    clusters = spark.createDataFrame([(["y", "x", "z"], "y", "region-form", 5)], "members array<string>, `into` string, signal string, class int")
    got = rows(curate.decision_records(merges, found, "entities", "r", "t", drops, clusters).select("action", F.array_join("from", " "), "signal"))
    assert got == [("cluster", "x z", "region-form"), ("drop", "d", "model"), ("merge", "a", "alias"), ("merge", "c", "model")]


def test_records_of_a_part_whose_size_is_its_number(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3.0), (2, 2, -1.0)], "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1,)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, 7), (8, 7), (9, 23)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    check(QUERIES["curation_records"](spark, str(tmp_path)), ORACLES["curation_records"], str(tmp_path))


def test_ledger_versions(spark, tmp_path):
    path, schema = f"file://{tmp_path}/ledger", "k int"
    assert sinks.current_table(spark, path, schema).count() == 0
    for n in range(4):
        now = sinks.current_table(spark, path, schema)
        sinks.replace_table(now.union(spark.createDataFrame([(n,)], schema)), path)
    assert rows(sinks.current_table(spark, path, schema)) == [(0,), (1,), (2,), (3,)]
    (tmp_path / "ledger/v0000000005").mkdir()  # a write that was cut off
    assert sinks.current_table(spark, path, schema).count() == 4 and len(os.listdir(tmp_path / "ledger")) == 3
    sinks.replace_table(sinks.current_table(spark, path, schema), path)
    assert sinks.current_table(spark, path, schema).count() == 4


def test_added_source(tmp_path):
    (tmp_path / "my report.PDF").write_bytes(b"x")
    assert sinks.add_source(f" '\"{tmp_path}/my report.PDF\"' ", str(tmp_path / "raw")) == "my report.PDF" and os.listdir(tmp_path / "raw") == ["my report.PDF"]
    with pytest.raises(ValueError):
        sinks.add_source("x.txt", str(tmp_path))


def test_counters_and_metrics(spark):
    rec = "chunk_id string, entities array<int>, relationships array<int>, claims array<struct<type: string>>"
    c = ingest.extraction_counters(spark.createDataFrame([("a", [1], [1, 2], [("t",), ("t",), ("u",), (None,)]), ("b", None, None, None)], rec))
    assert {r.chunk_id: (r.entities, r.relationships, r.claims, r.claimsByType) for r in c.collect()} == {"a": (1, 2, 4, {"t": 2, "u": 1}), "b": (0, 0, 0, {})}
    w = state.written_by_type(spark.createDataFrame([("topics/a",), ("comparisons/b",)], "path string"), 0)
    assert rows(w) == [("entity", 1), ("topic", 1)]


def test_verdict_without_record(spark):
    h = lambda *x: spark.createDataFrame(x, "path string, hash string")
    assert rows(state.write_verdicts(h(("a", "1")), h(("a", "2")), h(("b", "1")))) == [("a", "write")]


def test_enforcers(spark):
    one = lambda page, c: spark.createDataFrame([(page,)], "page string").select(c).collect()[0][0]
    page = "---\ntitle: x\naliases:\n  - old\nsparse: true\ntype: e\n---\nsparse: body\n"
    assert one(page, render.enforce_sparse("page", F.lit(False))) == "---\ntitle: x\naliases:\n  - old\ntype: e\n---\nsparse: body\n"
    assert one(page, render.enforce_sparse("page", F.lit(True))).count("sparse: true") == 1
    assert one(page, render.enforce_aliases("page", F.lit("Long"), F.lit("x"), F.array(F.lit("long"), F.lit("More")))) == '---\ntitle: x\nsparse: true\ntype: e\naliases: ["Long", "More"]\n---\nsparse: body\n'
    assert "aliases" not in one(page, render.enforce_aliases("page", F.lit("x"), F.lit("x"), F.array().cast("array<string>")))
    assert one("no head", render.enforce_sparse("page", F.lit(True))) == "no head"
    assert one("a\n\n## Sources\n\ns", render.enforce_bridge("page", F.lit("b"))) == "a\n\n## Bridge\n\nb\n\n## Sources\n\ns"
    assert one("a\n\n## Bridge\n\nold\n\n## Sources\n\ns", render.enforce_bridge("page", F.lit("b"))) == "a\n\n## Bridge\n\nb\n## Sources\n\ns"
    assert one("a", render.enforce_bridge("page", F.lit("b"))) == "a\n\n## Bridge\n\nb\n"


def test_prompt_values(spark):
    e = "page int, context string, file string, pages string"
    d = spark.createDataFrame([([(1, "c", "f", "1-2")], [])], f"m array<struct<{e}>>, none array<struct<{e}>>")
    assert d.select(render.prompt_mentions("m"), render.prompt_mentions("none")).collect()[0][:] == ('- Page 1: "c" (source: f, pages 1-2)', "(none)")
    r = "subject string, predicate string, object string, evidence string, page int, file string, pages string"
    d = spark.createDataFrame([([("s", "p", "o", "e", 1, "f", "1")], [("t", "p", "s", "e", 1, "f", "1")])], f"o array<struct<{r}>>, i array<struct<{r}>>")
    both = d.select(render.prompt_relationships("o", "i")).collect()[0][0]
    assert both.startswith("Outgoing (this entity is the SUBJECT of these relationships):\n- Subject: s\n  Predicate: p\n  Object: o\n") and both.endswith('Object: (this entity)\n  Evidence: "e"\n  Page: 1\n  Source: f, pages 1')
    d = spark.createDataFrame([([(2, "x/b", "3"), (1, "x/a", "2")],)], "c array<struct<n int, file string, pages string>>")
    assert d.select(render.prompt_citations("c")).collect()[0][0] == "[^src1]: a, pages 2\n[^src2]: b, pages 3"


def test_workspace_prose(spark):
    lines = spark.createDataFrame([("b", "- b"), ("a", "- a")], "wiki string, line string")
    body = render.workspace_index(lines, "about\nit")
    assert body.collect()[0].body.endswith("- a\n- b\n") and body.select(render.kept_prose("body")).collect()[0][0] == "about\nit"


def test_delinked(spark):
    p = spark.createDataFrame([("a", "[[known]] [[Some Title]] [[ghost]] [[gone|shown]]")], "path string, body string")
    known = spark.createDataFrame([("known", "known.md")], "key string, path string")
    titles = spark.createDataFrame([("some title", "k2")], "title string, key string")
    assert links.canonical_links(p, known, titles).collect()[0].body == "[[known]] [[k2|Some Title]] ghost shown"


def test_failures_of_outside_code(spark):
    c = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "bucket int, slug string")

    def judge(rows_):
        if rows_[0]["bucket"]:
            raise seams.SeamFailure("no answer")
        return str(len(rows_))

    assert seams.curate(c, judge) == [(0, "2"), (1, '{"merges": [], "drops": []}')]
    with pytest.raises(KeyError):
        seams.curate(c, lambda r: r[0]["no such field"])
    f = spark.createDataFrame([("a", "x"), ("b", "y")], "folder string, body string")
    got = seams.write_indexes(f, lambda k, b, fb: b * 2 if k == "a" else "bad", lambda b, t: [] if t == b * 2 else ["no"])
    assert rows(got) == [("a", "xx", True), ("b", "y", False)]
    assert seams.propose("old", lambda x: "new", lambda t: t != "new") == "old"


def test_related_of_composites(spark):
    m = spark.createDataFrame([("i", "a"), ("i", "b")], "`into` string, slug string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "subject string, object string")
    claims = spark.createDataFrame([(["a", "d"],)], "entities array<string>")
    assert rows(aggregate.related_composite(m, edges, claims)) == [("i", ["c", "d"])]


def test_extraction_records_are_parsed_once(spark):
    """One scan and one parse: each further one costs as much as the whole query."""
    from folioforge.operators import corpus

    plan = corpus.extraction_records(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("Relation [") == 1
    assert "regexp_extract(" not in plan


def test_edit_distance_of_short_and_long_slugs(spark):
    """All pairs by hand, tails of both kinds; numbered names alone don't meet."""
    import random

    r = random.Random(4)
    made = set()
    for n in (10, 11, 15, 31, 34, 35, 60):
        for _ in range(6):
            s = "".join(r.choice("abc1") for _ in range(n))
            made.add(s)
            for _ in range(6):
                x = list(s)
                for _ in range(r.choice((1, 2, 2, 3))):
                    i = r.randrange(len(x) // 2, len(x))
                    x[i : i + r.randrange(2)] = r.choice(("", "a", "1", "zz"[: r.randrange(3)]))
                made.add("".join(x))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    bare = lambda s: "".join(x for x in s if not x.isdigit())
    want = set()
    for a in made:
        for b in made:
            n = -(-len(a) // 2)
            if len(a) >= 10 and (len(a) < len(b) or len(a) == len(b) and a < b) and a[:n] == b[:n] and bare(a) != bare(b) and distance(a, b) <= 2:
                want.add((a, b) if len(b) > len(a) else (b, a))
    assert len(want) > 200 and any(len(a) > 50 for a, _ in want)
    df = spark.createDataFrame([(s, s) for s in sorted(made)], "pos string, slug string")
    got = resolve.edit_distance(df).select("from", "into").collect()
    assert len(got) == len(want) and {(x["from"], x["into"]) for x in got} == want
    numbered = df.sparkSession.range(20000).selectExpr("concat('customer-', lpad(id, 9, '0')) as slug").selectExpr("slug as pos", "slug")
    assert resolve.edit_distance(numbered).count() == 0


def test_collapse_broadcasts_no_labels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "`from` long, `into` long")
    merges, rejected = curate.collapse(edges)
    assert sorted(map(tuple, merges.collect())) == [(1, 3), (2, 3), (7, 8)] and rejected.count() == 0
    part = curate.connected_components(edges, "from", "into")
    m = part.join(edges.select(F.col("from").alias("node")), "node")
    assert "BroadcastHashJoin" in m._jdf.queryExecution().executedPlan().toString()  # the tables are small enough
    plan = curate.collapse(edges)[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_row_values_are_read_once(spark):
    """Once a use: cells are split in one place, and missing values come of one pass over pages and tables."""
    from folioforge.operators import preserve

    t = spark.createDataFrame([("a", "f", 1, "| h |\n|--|\n| x | 1 |\n| y | 2 and 3 |")], "path string, file string, page int, markdown string")
    m = preserve.missing_row_values(spark.createDataFrame([("a", "x and 3, y")], "path string, body string"), t)
    assert sorted((r.subject, r.value) for r in m.collect()) == [("x", "1"), ("y", "2")]
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("Join") == 1
