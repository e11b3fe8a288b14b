import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from folioforge.llm import bpe, decontam, line_dedup, near_dedup, quality
from tests.conftest import DATA


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def line_passes(line):
    """The rules of a line in plain Python."""
    t = line.strip(" ")
    low, words = t.lower(), re.split(" +", t.lower())
    return (
        (len(t) <= quality.SHORT or re.search(quality.ENDING, t) is not None)
        and len(re.findall(quality.MARKS, t)) <= quality.MAX_MARKS * len(t)
        and t.count("!!") <= quality.MAX_SHOUTS
        and len(re.findall(quality.SEPARATORS, t)) <= quality.MAX_SEPARATORS
        and not re.search(quality.NAVIGATION, low)
        and not any(p in low for p in quality.PHRASES)
        and (len(words) < quality.REPEAT_WORDS or len(set(words)) >= quality.MIN_DISTINCT * len(words))
    )


def plain_pipeline(docs, items):
    """doc_id to token ids, by loops over rows and pairs."""
    good = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not x.strip(" ") or line_passes(x)]
        n, k = (sum(len(x.strip(" ")) for x in a) for a in (lines, kept))
        if n and k >= quality.MIN_KEPT * n:
            good[d] = "\n".join(kept)
    norm = lambda x: re.sub("[ \t\r\f\v\u00a0]+", " ", x.lower()).strip(" ")
    own = {d: {norm(x) for x in t.split("\n")} - {""} for d, t in good.items()}
    count = Counter(x for s in own.values() for x in s)
    holder = {x: min(d for d, s in own.items() if x in s) for x, c in count.items() if c > line_dedup.MAX_DOCS}
    good = {d: "\n".join(x for x in t.split("\n") if holder.get(norm(x), d) == d) for d, t in good.items()}
    sets = {}
    for d, t in good.items():
        w = words_of(t)
        sets[d] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else {t}
    group = {d: d for d in good}
    for d in sorted(good):
        for e in sorted(good):
            if e < d and len(sets[d] & sets[e]) >= near_dedup.THRESHOLD * len(sets[d] | sets[e]):
                a, b = sorted((group[d], group[e]))
                group = {k: a if v == b else v for k, v in group.items()}
    good = {d: t for d, t in good.items() if group[d] == d}
    grams = {}
    for item in items:
        w = words_of(item)
        n = min(decontam.MIN_SPAN, len(w))
        for i in range(len(w) - n + 1):
            grams.setdefault(n, set()).add(tuple(w[i : i + n]))
    leaks = lambda w: any(tuple(w[i : i + n]) in g for n, g in grams.items() for i in range(len(w) - n + 1))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})
    return {d: (enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in good.items() if not leaks(words_of(t))}


def test_run_equals_plain_python(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_pipeline([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: (r.token_ids, r.sha) for r in got} == want and len(got) == len(want) and all(r.n_tokens == len(r.token_ids) for r in got)


def test_stages_take_awkward_rows(spark, tmp_path):
    rows = [(None, None, "x"), (1, None, "x"), (1, "a line of text.", "x"), (1, "a line of text.", "x"), (2, "", None), (3, "word " * 9000, "y"), (None, "kept, though it has no number.", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, line string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        assert k == len(corpus_pipeline.STAGES) - 1 or read.columns == docs.columns
        docs = read
    assert sorted((r.doc_id or 0, r.n_tokens) for r in docs.collect()) == [(0, 8), (1, 5)]


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, read = docs.columns, docs
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read, DATA).write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(read)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert read.columns == columns
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] == {r.doc_id for r in quality.report(docs).collect()} and ids[1] == ids[0]
    assert not near_dedup.duplicate_groups(tables[2]).count() and len(ids[2]) < len(ids[1])
    assert decontam.contamination(tables[3], spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0 and ids[3] <= ids[2]
    text = {r.doc_id: r.text for r in tables[3].collect()}
    assert {r.doc_id: r.sha for r in tables[4].collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in text.items()}


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_large_groups_of_copies_leave_one(spark, docs_of):
    copy, other = "the first line of a text\nthat is copied very often", "another text\n\nof which there are many copies"
    texts = [copy] * 60 + [other] * 70 + ["!!!", "!!!", "...", None, None, "a text of its own, with words that no other has"]
    stripped = corpus_pipeline.line_dedup_stage(spark, docs_of(texts), DATA)
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup_stage(spark, stripped, DATA).collect()}
    # the whole copies stay, and of the texts that lost all lines one
    assert kept == {0: copy, 1: "", 60: other, 130: "!!!", 132: "...", 133: None, 134: None, 135: texts[-1]}
