import json

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import aggregate, curate, extract, ingest, links, preserve, render, resolve, state
from folioforge.plans import seams
from folioforge.plans.components import connected_components
from folioforge.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cands(spark, *items):
    data = [(i, x, x.replace("-", " "), []) if isinstance(x, str) else (i, *x) for i, x in enumerate(items)]
    return spark.createDataFrame(data, "pos int, slug string, title string, aliases array<string>")


def pairs(df):
    return sorted((r["from"], r["into"], r["signal"], r["tier"]) for r in df.collect())


def test_plain_text_table(spark):
    page = "Revenue by Quarter\nQuarter Revenue Growth\nQ1 $9.8M +4%\nQ2 $10.4M +6%\nQ3 $11.1M +7%\nTotal revenue for the year reached $42.5 million, exceeding the"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(page.split("\n"))], "doc int, pos int, line string")
    got = ingest.detect_tables(lines).collect()[0]
    assert got.tables_found == 1
    assert got.body.startswith("Revenue by Quarter\n| Quarter | Revenue | Growth |\n| --- | --- | --- |\n| Q1 | $9.8M | +4% |")


def test_chunks_and_status(spark):
    pages = spark.createDataFrame([("My Report.pdf", i, f"p{i}") for i in (7, 2, 1, 3, 4, 5, 6)], "source string, page_no int, text string")
    got = [(r.chunk_id, r.pages, r.body) for r in ingest.chunk_pages(pages).orderBy("chunk_ord").collect()]
    assert got == [("my-report-part-001", "1-5", "p1\np2\np3\np4\np5"), ("my-report-part-002", "6-7", "p6\np7")]
    f = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "slug string, hash string")
    ledger = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "slug string, hash string")
    assert {r.slug: r.status for r in ingest.source_status(f, ledger).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "removed"}
    assert rows(ingest.to_process(f, ledger)) == [("b", "2"), ("c", "3")]


def test_transliteration_is_automatic_in_danish_only(spark):
    c = cands(spark, "regionshospitalet-godstrup", "regionshospitalet-goedstrup")
    assert pairs(resolve.detect(c, "da")[0]) == [("regionshospitalet-godstrup", "regionshospitalet-goedstrup", "transliteration", "auto")]
    assert pairs(resolve.detect(c, "en")[0]) == [("regionshospitalet-godstrup", "regionshospitalet-goedstrup", "edit-distance", "proposed")]


def test_edit_distance(spark):
    c = cands(spark, "landspatientregistret", "landspatientregisteret", "sundhedsvaesenet", "sundhedsvaesenets", "ct-skanning", "mr-skanning")
    assert [p[:3] for p in pairs(resolve.detect(c, "da")[0])] == [("landspatientregistret", "landspatientregisteret", "edit-distance"), ("sundhedsvaesenet", "sundhedsvaesenets", "edit-distance")]
    for a, b in (("abcdefghijkx", "abcdefghijky"), ("abcdefghijky", "abcdefghijkx")):
        assert [p[:2] for p in pairs(resolve.detect(cands(spark, a, b), "en")[0])] == [(b, a)]


def test_alias_and_abbreviation(spark):
    c = cands(spark, ("lpr", "LPR", []), ("landspatientregisteret", "Landspatientregisteret", ["Registeret", "LPR"]))
    assert pairs(resolve.detect(c, "da")[0]) == [("lpr", "landspatientregisteret", "alias", "auto")]
    c = cands(spark, "lpr", "landspatientregisteret")
    corpus = spark.createDataFrame([("Data fra Landspatientregisteret (LPR) og Verdenssundheden (WHO).",)], "text string")
    assert pairs(resolve.detect(c, "da", corpus)[0]) == [("lpr", "landspatientregisteret", "abbreviation", "proposed")]


def test_abbreviation_over_any_blanks(spark):
    c = cands(spark, "nhr", "national-health-register")
    for text in ("the National\nHealth  Register (NHR)", "Fra National Health\tRegister(NHR)".replace("Fra", "fra"), "and the National Health Register\n(NHR)"):
        assert pairs(resolve.detect(c, "da", spark.createDataFrame([(text,)], "text string"))[0]) == [("nhr", "national-health-register", "abbreviation", "proposed")], text


def test_subsequence_initials_glossary(spark):
    assert [p[:3] for p in pairs(resolve.detect(cands(spark, "peter-olsen-svenningsen", "peter-svenningsen"), "da")[0])] == [("peter-olsen-svenningsen", "peter-svenningsen", "subsequence")]
    assert [p[:3] for p in pairs(resolve.detect(cands(spark, "moeller-m-h", "morten-moller"), "da")[0])] == [("moeller-m-h", "morten-moller", "initials")]
    terms = spark.createDataFrame([(0, "echocardiography", "echocardiography", "en"), (0, "ekkokardiografi", "ekkokardiografi", "da")], "group int, term string, slug string, lang string")
    assert [p[:3] for p in pairs(resolve.detect(cands(spark, "echocardiography", "ekkokardiografi"), "da", terms=terms)[0])] == [("echocardiography", "ekkokardiografi", "glossary")]


def test_initials_on_both_sides(spark):
    initials = lambda *slugs: [p[:3] for p in pairs(resolve.detect(cands(spark, *slugs), "da")[0]) if p[2] == "initials"]
    assert initials("anders-m-hansen", "a-m-hansen") == [("a-m-hansen", "anders-m-hansen", "initials")]
    assert initials("jens-p-moeller", "j-peter-moeller") == [("j-peter-moeller", "jens-p-moeller", "initials")]
    assert initials("anna-b-c-d-e-hansen", "a-b-c-d-e-hansen") and initials("region-nord-a-hansen", "region-nord-anders-hansen")
    for other in (("hansen-a", "hansen-b"), ("hansen-jens", "hansen-anders"), ("anders-m-hansen", "a-karl-hansen"), ("odense-2", "odense-2tal"), ("anders-de-hansen", "a-de-hansen")):
        assert initials(*other) == [], other


def test_clusters(spark):
    c = cands(spark, *[f for x in ("nord", "syd") for f in (x, f"{x}-region", f"region-{x}")])
    p, k = resolve.detect(c, "da")
    assert pairs(p) == [] and sorted(r["members"] for r in k.collect()) == [["region-nord", "nord-region", "nord"], ["region-syd", "syd-region", "syd"]]
    p, k = resolve.detect(cands(spark, "indikator-2-ct-skanning", "ct-skanning", "indikator-2", "indikator-3"), "da")
    assert [x[:2] for x in pairs(p)] == [("indikator-2-ct-skanning", "indikator-2")]
    assert [r["members"] for r in k.collect()] == [["indikator-2-ct-skanning", "ct-skanning"]]


def test_controls_find_nothing(spark):
    c = cands(spark, *"odense-bup-auditorium odense-bup odense odense-2 indikator-2 indikator-3 morten-moller peter-moller topic-a topic-b ct-skanning mr-skanning naestved naestved-hospital".split())
    p, k = resolve.detect(c, "da")
    assert pairs(p) == [] and k.count() == 0


def test_vetoes(spark):
    c = cands(spark, "regionshospitalet-godstrup", "regionshospitalet-goedstrup")
    never = spark.createDataFrame([("regionshospitalet-goedstrup", "regionshospitalet-godstrup")], "a string, b string")
    assert pairs(resolve.detect(c, "da", never=never)[0])[0][3] == "vetoed"


def test_merge_graph(spark):
    e = lambda *x: spark.createDataFrame(x, "`from` string, `into` string")
    m, bad = curate.collapse(e(("a-x", "b-x"), ("b-x", "c-x")))
    assert rows(m) == [("a-x", "c-x"), ("b-x", "c-x")] and bad.count() == 0
    m, bad = curate.collapse(e(("a-x", "b-x"), ("b-x", "a-x")))
    assert m.count() == 0 and bad.collect()[0].reason == "no unique survivor"
    m, _ = curate.collapse(e(("a-x", "b-x"), ("b-x", "a-x")), lenient=True)
    assert rows(m) == [("a-x", "b-x")]


def test_components_any_partitioning(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200), (None, 5)]
    for n in (1, 7):
        df = spark.createDataFrame(chain, "src int, dst int").repartition(n)
        got = {r.node: r.component for r in connected_components(df).collect()}
        assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_packing():
    assert curate.pack(["b-1", "a-2", "a-1", "a-3"], max_rows=3) == [["a-1", "a-2", "a-3"], ["b-1"]]


def test_decision_errors(spark):
    reply = json.dumps({"merges": [{"from": ["a", "a", "ghost"], "into": "b", "justification": "x" * 200}, {"from": ["c"], "into": "c"}], "drops": [{"slug": "b"}], "keep": ["a"], "clusters": [{"members": ["d"], "class": 9, "into": "d"}]})
    d = curate.parse_decisions(spark.createDataFrame([(0, f"```json\n{reply}\n```")], "bucket int, reply string"))
    first = d.collect()[0].merges[0]
    assert first["from"] == ["a", "ghost"] and len(first.justification) == 120
    known = spark.createDataFrame([(x,) for x in "abcd"], "slug string")
    got = {(r.slug, r.error) for r in curate.decision_errors(d, known).collect()}
    assert {("ghost", "unknown slug"), ("c", "merged into itself"), ("a", "judged twice"), ("b", "survivor is dropped"), ("d", "cluster needs 2 to 4 members"), ("d", "cluster class is 1 to 5")} <= got


def test_attachment_is_bounded_by_order(spark):
    obs = spark.createDataFrame([("alpha", "A", "t", "f", "s", 1, 0), ("beta", "B", "t", "f", "s", 5, 0), ("alpha", "A2", "t", "f2", "s", 2, 0)], "slug string, name string, type string, folder string, significance string, chunk_ord int, pos int")
    memory = spark.createDataFrame([("beta", "kept")], "slug string, folder string")
    for n in (1, 7, 64):
        e = aggregate.entities(obs.repartition(n), memory)
        assert {r.slug: (r.name, r.folder) for r in e.collect()} == {"alpha": ("A", "f"), "beta": ("B", "kept")}
    rels = spark.createDataFrame([("beta", "p", "alpha", "ev", 1, 2, 0), ("alpha", "p", "beta", "ev", 1, 5, 1), ("alpha", "p", "alpha", "ev", 1, 5, 2)], "subject string, predicate string, object string, evidence string, page int, chunk_ord int, pos int")
    assert [r.subject for r in aggregate.outgoing(rels, e).orderBy("pos").collect()] == ["alpha", "alpha"]
    assert sorted((r.slug, r.subject) for r in aggregate.incoming(rels, e).collect()) == [("alpha", "beta"), ("beta", "alpha")]


def test_first_evidence_stays(spark):
    r = spark.createDataFrame([("a", "a", "p", "b", 1, "f", "1", ev, i, 0) for i, ev in enumerate(("first", "second"))], "slug string, subject string, predicate string, object string, page int, file string, pages string, evidence string, chunk_ord int, pos int")
    assert [x.evidence for x in aggregate.dedupe(r, "relationships").collect()] == ["first"]


def test_related_and_remap(spark):
    edges = spark.createDataFrame([("self", "obj-a"), ("subj-b", "self")], "subject string, object string")
    claims = spark.createDataFrame([(["self", "co-c", "obj-a"],)], "entities array<string>")
    got = {r.slug: r.related for r in aggregate.related(edges, claims).collect()}
    assert got["self"] == ["co-c", "obj-a", "subj-b"]
    m = spark.createDataFrame([("a", "z"), ("b", "z")], "old string, new string")
    c = spark.createDataFrame([(1, ["b", "x", "a"]), (2, []), (3, None)], "id int, entities array<string>")
    assert {r.id: r.entities for r in aggregate.remap_array(c, "entities", m, ["id"]).collect()} == {1: ["z", "x"], 2: [], 3: []}


def test_citations_and_page(spark):
    ev = spark.createDataFrame([("p", "b.pdf", "1", 1, 1, 0), ("p", "a.pdf", "2", 0, 2, 0), ("p", "a.pdf", "2", 3, 1, 0)], "page_id string, file string, pages string, kind int, chunk_ord int, pos int")
    n = aggregate.number_citations(ev)
    assert {(r.file, r.n) for r in n.collect()} == {("a.pdf", 1), ("b.pdf", 2)}
    assert render.sources_section(n).collect()[0].sources == "[^src1]: a.pdf, pages 2\n[^src2]: b.pdf, pages 1"


def test_links(spark):
    pages = spark.createDataFrame([("entities/a.md", "see [[b]] and [[entities/c|C]] [[ghost]]"), ("entities/b.md", "[[b]]"), ("entities/sub/c.md", "none"), ("entities/index.md", "[[a]]")], "path string, body string")
    u = links.universe(pages)
    r = links.resolve_links(links.page_links(pages), u)
    assert rows(links.broken(r).select("path", "target")) == [("entities/a.md", "entities/c"), ("entities/a.md", "ghost")]
    d = links.degrees(pages, r.where("to is not null"))
    assert rows(links.orphans(d)) == [("entities/sub/c.md",)]
    assert rows(links.islands(d)) == [("entities/sub/c.md",)]


def test_link_repair(spark):
    t = spark.createDataFrame([("indikator-2",), ("region",), ("ghost-entity",), ("hjerte-maaling",)], "target string")
    slugs = spark.createDataFrame([("indikator-2-ekkokardiografi",), ("region-nord",), ("region-syd",), ("ekko",)], "slug string")
    al = spark.createDataFrame([("Hjerte måling", "ekko")], "alias string, slug string")
    got = {r.target: (r.to, r.rule, r.candidates) for r in links.repair_targets(t, slugs, al, "da").collect()}
    assert got == {"indikator-2": ("indikator-2-ekkokardiografi", "prefix", []), "region": (None, None, ["region-nord", "region-syd"]), "ghost-entity": (None, None, []), "hjerte-maaling": ("ekko", "alias", [])}
    pages = spark.createDataFrame([("a", "x [[indikator-2|Indikator 2]] [[other]]"), ("b", "nothing")], "path string, body string")
    fixed = links.repair_pages(pages, links.repair_targets(t, slugs, al, "da"))
    assert rows(fixed) == [("a", "x [[indikator-2-ekkokardiografi|Indikator 2]] [[other]]")]


def test_citation_and_schema_issues(spark):
    body = "text [^src1] [^src2] [^src3]\n\n[^src1]: a.pdf, p. 1\n[^src2]: gone.pdf, p. 2"
    p = spark.createDataFrame([("entities/x.md", body, ["b.pdf"])], "path string, body string, sources array<string>")
    raw = spark.createDataFrame([("a.pdf",)], "file string")
    assert rows(links.citation_issues(p, raw).select("key", "issue")) == [("src1", "missing in frontmatter"), ("src2", "missing in frontmatter"), ("src2", "missing source"), ("src3", "invalid")]
    s = spark.createDataFrame([("a", "T", "composite", "2024-01-01T00:00:00.000Z", ["x"], 7), ("b", " ", "odd", "2024", None, None)], "path string, title string, type string, updated string, members array<string>, class int")
    assert rows(links.schema_issues(s)) == [("a", "composite needs 2 to 4 members"), ("a", "composite needs class 1 to 5"), ("b", "title is missing"), ("b", "type is unknown"), ("b", "updated is no ISO timestamp")]


def test_preservation(spark):
    pages = spark.createDataFrame([("x", "one [^src1]\ntwo [^src9] [^src9]")], "path string, body string")
    cites = spark.createDataFrame([("x", "src1"), ("x", "src2")], "path string, key string")
    assert rows(preserve.missing_citations(pages, cites)) == [("x", "src2")]
    assert rows(preserve.off_map_citations(pages, cites)) == [("x", "src9", 2, "two [^src9] [^src9]")]
    ev = spark.createDataFrame([("x", "claim", "two"), ("x", "claim", "three"), ("x", "claim", "")], "path string, kind string, text string")
    assert rows(preserve.missing_evidence(pages, ev)) == [("x", "claim", "three")]


def test_contains_where_words_go_on(spark, tmp_path):
    items = [(1, "a brave new world"), (2, "world"), (3, "old worl"), (4, " inner "), (5, None)]
    docs = [(1, "it is a brave new worlds apart"), (2, "the bold worlds"), (3, "an inner thing"), (4, None), (5, "a brave newer world")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(rows(preserve.preservation_contains(spark, str(tmp_path)))) == [(1, 1), (2, 1), (2, 2), (2, 5), (3, 2), (4, 3)]


def test_comparison_drift(spark):
    md = "| Region | Andel |\n| --- | --- |\n| Danmark | 79,2 |\n| Syddanmark | 82,2 |"
    body = "# T\n\n## Table: One (report-2023.pdf, p. 16)\n\n" + md.replace("82,2", "82,9") + "\n\n## Table: Two (report-2024.pdf, p. 15)\n\n82,2"
    pages = spark.createDataFrame([("c", body)], "path string, body string")
    t = spark.createDataFrame([("c", "raw/report-2023.pdf", 16, md)], "path string, file string, page int, markdown string")
    m = preserve.missing_row_values(pages, t)
    assert [r[0] for r in m.select(preserve.row_finding(F.col("file"), F.col("page"), F.col("subject"), F.col("value"))).collect()] == ['report-2023.pdf, p. 16 row "Syddanmark": value "82,2"']


def test_render_and_splice(spark):
    d = spark.createDataFrame([("## A\n\nold\n\n## B\n\nb\n",)], "body string")
    assert d.select(render.splice_section("body", "A", F.lit("new"))).collect()[0][0] == "## A\n\nnew\n## B\n\nb\n"
    assert d.select(render.splice_section("body", "C", F.lit("c"))).collect()[0][0].endswith("b\n\n## C\n\nc\n")
    p = spark.createDataFrame([("---\ntitle: x\nsparse: false\n---\nb",)], "page string")
    assert p.select(render.enforce_field("page", "sparse", F.lit("true"))).collect()[0][0] == "---\ntitle: x\nsparse: true\n---\nb"
    assert p.select(render.enforce_field("page", "class", F.lit("3"))).collect()[0][0] == "---\ntitle: x\nsparse: false\nclass: 3\n---\nb"


def test_state(spark):
    h = lambda *x: spark.createDataFrame(x, "path string, hash string")
    got = {r.path: r.verdict for r in state.write_verdicts(h(("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")), h(("a", "1"), ("b", "x"), ("c", "y")), h(("a", "0"), ("b", "x"), ("c", "z"))).collect()}
    assert got == {"a": "converge", "b": "write", "c": "conflict", "d": "write"}
    kind = "concern string, action string, `from` array<string>, `into` string, signal string, decidedAt string, runId string"
    ledger = spark.createDataFrame([("e", "merge", ["b", "a"], "c", "model", "1", "r")], kind)
    new = spark.createDataFrame([("e", "merge", ["a", "b"], "c", "model", "2", "s"), ("e", "merge", ["x"], "y", "model", "2", "s")], kind)
    out, splits = state.append_decisions(ledger, new, spark.createDataFrame([("x",), ("q",)], "slug string"))
    assert out.count() == 2 and rows(splits) == [("q",)]
    r = spark.createDataFrame([("s", i, i > 5) for i in range(20)], "stage string, pos int, ok boolean")
    assert state.outages(r).collect()[0][1:] == (6, 0.3, True)


def test_extraction_schema(spark):
    rec = {"entities": [{"name": "A", "type": "t", "slug": "Søren Møller", "folder": "entities/Ægte/x", "significance": "s", "mentions": [{"page": 9, "context": "c"}]}], "relationships": [], "claims": [{"text": "c", "type": "Big Type", "page": 2}], "context": "x"}
    got = extract.parse_replies(spark.createDataFrame([("c-part-001", "```json\n" + json.dumps(rec) + "\n```"), ("c-part-002", "[oops")], "chunk_id string, reply string"))
    n = extract.normalise(got, "da")
    e = n.where("ok").collect()[0]
    assert e.entities[0].slug == "soeren-moeller" and e.entities[0].folder == "entities/aegte/x" and e.claims[0].type == "big-type"
    chunks = spark.createDataFrame([("c-part-001", "1-3"), ("c-part-002", "x")], "chunk_id string, pages string")
    issues = rows(extract.schema_issues(n, chunks).select("chunk_id", "field", "issue"))
    assert ("c-part-001", "entities[0]", "page outside the chunk") in issues and ("c-part-001", "timeline", "is missing") in issues and ("c-part-001", "claims[0]", "entities is no list") in issues and ("c-part-002", "record", "is missing") in issues


def test_frontmatter_and_bullets(spark):
    page = "---\ntitle: \"A: b\"\ntype: entity\nsources:\n  - file: x.pdf\n    pages: 1-3\naliases: [a, b]\n---\n# A\n\n## Facts\n- one\n- two\n## Other\n- three\n"
    f = readers.frontmatter(spark.createDataFrame([("a.md", page), ("b.md", "no head")], "path string, page string"))
    a = f.where("path = 'a.md'").collect()[0]
    assert a.title == "A: b" and a.sources[0].pages == "1-3" and a.aliases == ["a", "b"]
    assert [r.bullet for r in readers.section_bullets(f, "Facts").orderBy("pos").collect()] == ["one", "two"]


def test_scans_and_stream(spark, tmp_path):
    from folioforge.streaming.incremental import ingest_stream, read_ledger

    (tmp_path / "w/entities").mkdir(parents=True)
    (tmp_path / "w/AGENTS.md").write_text("guide")
    (tmp_path / "w/entities/a.md").write_text("x")
    assert rows(readers.markdown_pages(spark, str(tmp_path / "w"))) == [("entities/a.md", "x")]
    (tmp_path / "log.jsonl").write_text('{"timestamp": "2024", "model": "m", "inputTokens": 3, "outputTokens": 1, "cost": 0.5}\n{"torn": \n')
    assert state.usage_since(readers.call_log(spark, str(tmp_path / "log.jsonl")), "2023").collect()[0].inputTokens == 3
    seen = []
    src, led, ck = (str(tmp_path / x) for x in ("in", "ledger", "ck"))
    for batch in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3")]):
        spark.createDataFrame(batch, "slug string, text string").write.mode("append").parquet(src)
        ingest_stream(spark, spark.readStream.schema("slug string, text string").parquet(src), led, ck, lambda df, n: seen.append(sorted(r.slug for r in df.collect()))).awaitTermination()
    assert seen == [["a", "b"], ["b"]] and read_ledger(spark, led).count() == 2


def test_seams(spark):
    assert seams.retry_with_feedback(lambda f: len(f), lambda n: [] if n else ["again"]) == (1, 2, [])
    modes = seams.Modes(lambda d, f: "bad", lambda d, f: d if f else "bad", lambda d: "t:" + d, lambda d, p: [] if d in p else ["missing"])
    got = seams.synthesize(spark.createDataFrame([("p", "data")], "path string, data string"), modes).collect()[0]
    assert (got.page, got.mode, got.attempts) == ("data", "permissive", 5)


def test_template():
    assert T.language_directive("en", "en") == "" and "Danish" in T.language_directive("da", "en", "curation")
    prompt = "a\n=== LANGUAGE ===\n{languageDirective}\n\nb"
    assert T.apply_directive(prompt, "") == "a\nb" and T.apply_directive(prompt, "x") == "a\n=== LANGUAGE ===\nx\n\nb"


def test_rounds_compose(spark):
    m = lambda *x: spark.createDataFrame(x, "old string, new string")
    drops = spark.createDataFrame([("z",)], "slug string")
    merges, gone = curate.compose_rounds(m(("a", "b"), ("x", "z")), m(("b", "c")), drops)
    assert rows(merges) == [("a", "c"), ("b", "c")] and rows(gone) == [("x",), ("z",)]
    seen = []
    first, second = seams.curate_in_rounds(spark.createDataFrame([(0, "a"), (1, "b")], "bucket int, slug string"), lambda r: seen.append([x["slug"] for x in r]) or "{}", lambda replies: spark.createDataFrame([(0, "a"), (0, "b")], "bucket int, slug string"))
    assert seen == [["a"], ["b"], ["a", "b"]] and len(first) == 2 and len(second) == 1


def test_indexes(spark):
    stats = render.folder_stats(spark.createDataFrame([("a/b/x.md",), ("a/y.md",), ("index.md",)], "path string"))
    assert rows(stats) == [("", 3, 1, 1), ("a", 2, 1, 1), ("a/b", 1, 1, 0)]
    assert {r.folder: r.level for r in render.write_order(stats, children_first=True).collect()} == {"": 0, "a": -1, "a/b": -2}
    w = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, wiki string")
    assert not render.prose_is_stale(w("p", "q"), w("p", "q"), "text").collect()[0].stale and render.prose_is_stale(w("p"), w("q"), "text").collect()[0].stale
    e = spark.createDataFrame([(1,)], "x int")
    assert {r["check"]: r.n for r in links.validation_summary(e, e.limit(0), e, e, e).collect()} == {"broken links": 1, "orphans": 0, "islands": 1, "citations": 1, "schema": 1}
