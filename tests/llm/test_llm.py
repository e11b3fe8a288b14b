"""The ten operators against brute force, round trips, labels and awkward tables."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import automaton, bpe, chat, decontam, license_scan, line_dedup, near_dedup, quality, secret_scan, substring_dedup, textblock, toxicity
from folioforge.llm import queries as registered
from tests.conftest import DATA
from tests.oracle import check

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
         "ærø über niño façade one two three four five six seven eight nine ten eleven twelve").split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


AWKWARD = [None, "", " \n\t ", "a", "word", "ÅÄÖ İstanbul ß", "x" * 20_000, "a b " * 5_000, "same text here", "same text here", "— “quoted” — ｗｉｄｅ 日本語", "line one.\nline two.\n\nline one."]


# ---- registration

def test_ten_operators_registered():
    assert [k for n in range(1, 11) for k in registered.QUERIES if k.startswith(f"op{n}_")] and len(registered.QUERIES) == 10


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_queries_equal_sql(spark, name):
    check(registered.QUERIES[name](spark, DATA), registered.ORACLES[name], DATA)


# ---- words

def test_words_of_a_batch():
    rng = random.Random(1)
    texts = [None, "", "Ab-c", "x" * 50 + " y", "“É” über_x", *[prose(rng, 9) + "." for _ in range(50)], "end"]
    w = textblock.Words(pa.array(texts, pa.string()).slice(1))
    assert w.counts().tolist() == [len(words_of(t)) for t in texts[1:]]
    h = w.hashes()
    seen = {}
    for a, b, x in zip(w.start, w.end, h):
        assert seen.setdefault(w.data[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
    v = np.array([5, 3, 9, 1, 7, 7, 2], np.uint64)
    assert [textblock.sliding_min(v, k).tolist() for k in (1, 3, 7, 8)] == [v.tolist(), [min(v[i : i + 3]) for i in range(5)], [1], []]


# ---- 1

def _encoding():
    import public_tokenizers as tokens
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})


def test_bpe_equals_reference_and_round_trips(spark, docs_of):
    rng = random.Random(2)
    letters = list(" \n\t'sdlmrvetaZéßñ1٣½$#-_ 　日本🙂́\x1c\x85")
    texts = AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["it's we'll   end  "]
    docs = docs_of(texts, extra=True)
    enc = _encoding()
    for dictionary in (bpe.DICTIONARY, 5):
        out = bpe.encode(docs, dictionary=dictionary)
        for r in out.select("*", bpe.decode(F.col("token_ids")).alias("back")).collect():
            t = texts[r.doc_id]
            assert (r.token_ids, r.n_tokens, r.back) == ((None,) * 3 if t is None else (enc.encode_ordinary(t), len(enc.encode_ordinary(t)), t))
    assert bpe.encode(docs.limit(0)).count() == 0
    sha = {r.doc_id: r.sha for r in bpe.encode_checked(docs_of(texts[:12])).collect()}
    assert sha == {i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts[:12])}


def test_long_words_merge_alike():
    enc, rng = _encoding(), random.Random(3)
    for w in ["a" * 1000, "".join(rng.choice("abcdeté日") for _ in range(400))]:
        assert bpe.merge_long(w.encode(), bpe.load_ranks(bpe.RANKS)) == enc.encode_ordinary(w)


def test_rare_words_merge_alike_and_are_not_folded_one_by_one(spark, docs_of):
    rng, ranks = random.Random(4), bpe.load_ranks(bpe.RANKS)
    words = ["".join(rng.choice("abcdehinorst é日") for _ in range(rng.randint(1, 20))).encode() for _ in range(3000)] + [b"a" * k for k in range(1, 65)] + [b"\xff", b" " * 64]
    ids, n = bpe.merge_words(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]), bpe.Merges(bpe.RANKS))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [bpe.merge_long(w, ranks) for w in words]
    docs = docs_of(["once " + "Zq" * 40, None, "", "twice twice"])
    out = bpe.encode(docs, dictionary=1)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.token_ids for r in out.collect()} == {r.doc_id: r.token_ids for r in bpe.encode(docs).collect()}


# ---- 2

def test_quality(docs_of):
    good = "This is a line of prose.\nAnd this one is another line of it, longer than the rest!"
    bad = "Home | News | Sport | Weather | More\nWORD!! WORD!! WORD!! WORD!! WORD!!\n" + "one### two$$$ three%%% four*** five&&& six###"
    texts = [good, bad, good + "\n" + "Home | A | B | C | D", None, "", "\n \n", "again " * 30, good]
    got = {r.doc_id: r for r in quality.clean(docs_of(texts, extra=True)).collect()}
    assert sorted(got) == [0, 2, 7] and got[2].text == good and got[2].n_chars == len(good)
    assert quality.clean(docs_of([])).count() == 0 and quality.report(docs_of(AWKWARD)).count() > 0


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.clean(docs).collect()}
    rows = labels.collect()
    assert np.mean([r.doc_id in kept for r in rows if r.quality == 1]) > 0.98 and np.mean([r.doc_id in kept for r in rows if r.quality == 0]) < 0.1


# ---- 3

def _shared(a, b, least):
    best = 0
    ids = defaultdict(list)
    for j in range(len(b) - least + 1):
        ids[tuple(b[j : j + least])].append(j)
    for i in range(len(a) - least + 1):
        for j in ids.get(tuple(a[i : i + least]), ()):
            n = least
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_decontamination_finds_every_long_span(spark, docs_of):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (10, 12, 14, 30, 60, 9, 8, 7, 5, 3)] + ["unheard"]
    texts = AWKWARD + [prose(rng, 40) for _ in range(20)] + ["an unheard-of word"]
    for item in items:
        w = item.split()
        for n in (9, 10, 11, len(w)):
            at = rng.randint(0, max(0, len(w) - n))
            texts.append(prose(rng, rng.randint(0, 20)) + " " + ", ".join(w[at : at + n]).upper() + ". " + prose(rng, 15))
    bench = spark.createDataFrame([*enumerate(items), (None, items[3]), (99, None)], "item_id bigint, text string")
    got = decontam.contamination(docs_of(texts, extra=True), bench).collect()
    best = defaultdict(int)
    for r in got:
        best[r.doc_id, r.item_id] = max(best[r.doc_id, r.item_id], r.n_words)
        a, b = words_of(texts[r.doc_id]), words_of(items[r.item_id])
        assert a[r.doc_word : r.doc_word + r.n_words] == b[r.item_word : r.item_word + r.n_words]
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            if n := _shared(words_of(t), words_of(x), min(decontam.MIN_SPAN, len(words_of(x)))):
                want[d, i] = n
    assert dict(best) == want and want
    clean = decontam.decontaminate(docs_of(texts, extra=True), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want} and "fps" in clean.columns
    assert decontam.contamination(docs_of([]), bench).count() == 0 and decontam.contamination(docs_of(texts), bench.limit(0)).count() == 0


# ---- 4

def test_chat_links_quotes(spark, tmp_path):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?", "x"), (1, 1, "assistant", "Fine.\n\nThanks a lot.", "x"), (1, 2, "user", "> How are  you?\nSecond reply", "x"),
        (1, 3, "assistant", "On Monday X wrote:\n> Fine.\n> \n> Thanks a lot.\n> > How are you?\nGlad", "x"), (1, 4, "user", "> nothing known\nok", "x"), (1, 5, "a", None, "x"),
        (2, 0, "x", "> q", "x"), (2, 1, None, ">> q\n> \nyes > no", "x"), (3, 0, "u", "alone", "x"), (3, 0, "u", "alone", "x"), (None, 1, "u", "t", "x"), (4, 0, "u", "", "x"), (5, 0, "u", "y\n" * 3000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, own string")
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    assert [(m.turn, m.parent, m.depth) for m in got[1].chat] == [(0, None, 0), (2, 0, 1), (1, None, 0), (3, 1, 1), (4, None, 0), (5, None, 0)]
    assert [m.text for m in got[1].chat] == ["Hello there.\nHow are you?", "Second reply", "Fine.\n\nThanks a lot.", "Glad", "ok", ""]
    assert got[1].n_links == 2 and got[3].n_messages == 1 and sorted(got) == [1, 2, 3, 4, 5]
    levels = [[(q.level, q.text) for q in r.quotes or []] for r in chat.parse(df.where("turn = 3").select("conv_id", "turn", "role", "text")).collect()]
    assert levels == [[(1, "Fine.\n\nThanks a lot."), (2, "How are you?")]]
    df.where("conv_id is not null").select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    check(chat.op4_chat(spark, str(tmp_path)), chat.ORACLE, str(tmp_path))
    assert chat.conversations(df.limit(0)).count() == 0


def test_chat_links_lines_out_of_a_message(spark):
    five, three = "one a\ntwo b\nthree c\nfour d\nfive e", "first x\nsecond x\n\nthird y\n\nfourth z"
    rows = [
        (1, 0, "u", five), (1, 1, "a", three), (1, 2, "u", "> Two b\n> three  c\nlines of a paragraph"), (1, 3, "a", "> first x\n> second x\n>\n> third y\ntwo of three paragraphs"),
        (1, 4, "u", "> two b\n> four d\nnot consecutive"), (1, 5, "u", "> second x\n> third y\n> fourth z\n>> four d\n>> five e\nacross a blank line"), (1, 6, "u", "> three c\n> two b\nanother order"),
        (2, 0, "u", "p\nq"), (2, 0, "v", "r\ns"), (2, 1, "u", "> q\n> r\nof two rows of one turn"), (2, 2, "u", "> k\n> l\nsaid later"), (2, 3, "u", "j\nk\nl"),
        (3, 0, "u", "k\nl\nm"), (3, 1, "u", "k\nk\nl\nm\nm"), (3, 2, "a", "> k\n> k\n> l\nrepeated lines"), (3, 2, "b", "> k\n> k\n> m\nanother row of the turn"),
    ]
    got = {r.conv_id: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {m.turn: (m.parent, m.depth) for m in got[1].chat} == {0: (None, 0), 1: (None, 0), 2: (0, 1), 3: (1, 1), 4: (None, 0), 5: (1, 1), 6: (None, 0)}
    assert got[2].n_links == 0 and {(m.turn, m.parent) for m in got[3].chat} == {(0, None), (1, None), (2, 1)}


# ---- 5

def _edit_ends(pattern, text, k):
    """Ends of substrings within k edits of the pattern (Sellers)."""
    col = list(range(len(pattern) + 1))
    out = set()
    for j, c in enumerate(text):
        last, col[0] = col[0], 0
        for i, p in enumerate(pattern, 1):
            last, col[i] = col[i], min(last + (p != c), col[i] + 1, col[i - 1] + 1)
        if col[-1] <= k:
            out.add(j + 1)
    return out


def test_licenses_against_dynamic_programming(docs_of):
    rng = random.Random(5)
    notices = tuple(license_scan.NOTICES.items())
    texts = list(AWKWARD)
    for _ in range(60):
        name, notice = rng.choice(notices)
        t = list(notice.upper() if rng.random() < 0.2 else notice)
        for _ in range(rng.randint(0, license_scan.edits(notice) + 2)):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        texts.append(prose(rng, 10) + ".\n" + "".join(t) + ". " + prose(rng, 10))
    got = license_scan.find_licenses(docs_of(texts, extra=True)).collect()
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r)
        (low, back), notice = license_scan.folded(texts[r.doc_id]), license_scan.NOTICES[r.license]
        assert r.edits <= license_scan.edits(notice) and r.end in {back(e - 1) + 1 for e in _edit_ends(notice, low, r.edits)}
    for d, t in enumerate(texts):
        low, back = license_scan.folded(t or "")
        for name, notice in notices:
            for end in _edit_ends(notice, low, license_scan.edits(notice)):
                end = back(end - 1) + 1
                assert any(r.start < end + license_scan.edits(notice) and r.end > end - len(notice) - license_scan.edits(notice) for r in found[d]), (d, name)
    assert license_scan.find_licenses(docs_of([])).count() == 0


def test_licenses_in_comments(docs_of):
    wrapped = "x = 1\n# Licensed under the Apache  License,\n#     Version 2.0 (the rest)\n/*\n * Redistribution and use in source and\n * binary forms, with or\r\n *\twithout modification\n */"
    got = {(r.license, wrapped[r.start : r.end], r.edits) for r in license_scan.find_licenses(docs_of([wrapped])).collect()}
    assert got == {("Apache-2.0", "Licensed under the Apache  License,\n#     Version 2.0", 0), ("BSD", "Redistribution and use in source and\n * binary forms, with or\r\n *\twithout modification", 0)}


# ---- 6

def test_repeated_passages_equal_brute_force(docs_of):
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (50, 51, 80, 300, 49)]
    texts = AWKWARD + [prose(rng, rng.randint(0, 200)) for _ in range(15)]
    for p in passages:
        for _ in range(rng.randint(2, 4)):
            texts.append(prose(rng, 20) + " zz. " + p.title() + "! yy " + prose(rng, 20))
    texts += [texts[-1], "alone " * 200, passages[0] + " " + passages[0]]
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(docs_of(texts, extra=True)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.n_docs > 1
        got[r.doc_id].update(range(r.start_word, r.end_word - 49))
    own = defaultdict(set)
    w = [words_of(t) for t in texts]
    for d, x in enumerate(w):
        for i in range(len(x) - 49):
            own[tuple(x[i : i + 50])].add(d)
    want = {d: s for d, x in enumerate(w) if (s := {i for i in range(len(x) - 49) if len(own[tuple(x[i : i + 50])]) > 1})}
    assert dict(got) == want and want
    assert substring_dedup.repeated_passages(docs_of([])).count() == 0


# ---- 7

def test_label_model_recovers_accuracies_and_correlation():
    rng = np.random.default_rng(7)
    n = 40_000
    y = rng.random(n) < 0.2
    rates = [(0.7, 0.02), (0.6, 0.05), (0.8, 0.03), (0.5, 0.01)]
    v = np.array([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in rates]).T.astype(np.int8)
    v = np.column_stack([v, np.where(rng.random(n) < 0.9, v[:, 3], v[:, 1])])  # mostly a copy of voter 3
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    m = toxicity.LabelModel(patterns, counts.astype(float))
    assert abs(m.prior - 0.2) < 0.02 and np.abs(m.accuracies()[:4] - np.array(rates)).max() < 0.05
    assert (3, 4) in {(i, j) for i, j, _ in m.correlations} and any({3, 4} <= set(g) for g in m.groups)


def test_label_model_against_enumeration():
    """Posteriors and one step of EM by loops over patterns, classes and groups."""
    rng = np.random.default_rng(17)
    patterns = ((np.arange(32)[:, None] >> np.arange(5)) & 1).astype(np.int8)
    counts = rng.integers(1, 200, 32).astype(float)
    m = toxicity.LabelModel(patterns, counts, rounds=7)
    assert sorted(x for g in m.groups for x in g) == list(range(5)) and all(len(g) <= toxicity.GROUP for g in m.groups)

    def entry(g, p):
        return sum(int(p[i]) << k for k, i in enumerate(g))

    post = m.posterior(patterns)
    for p, got in zip(patterns, post):
        joint = [1 - m.prior, m.prior]
        for g, t in zip(m.groups, m.tables):
            joint = [joint[c] * t[c][entry(g, p)] for c in (0, 1)]
        assert abs(got - joint[1] / sum(joint)) < 1e-9
    # what a step from these posteriors must give
    n = toxicity.LabelModel.__new__(toxicity.LabelModel)
    n.m, n.groups = m.m, m.groups
    start = [0.02 if not p.any() else min(0.95, 0.55 + 0.15 * int(p.sum())) for p in patterns]
    n._fit(patterns, counts, 1)
    assert abs(n.prior - min(0.5, max(1e-4, sum(a * c for a, c in zip(start, counts)) / counts.sum()))) < 1e-9
    for g, t in zip(n.groups, n.tables):
        for c in (0, 1):
            cells = [0.5] * (1 << len(g))
            for p, a, k in zip(patterns, start, counts):
                cells[entry(g, p)] += k * (a if c else 1 - a)
            assert np.allclose(t[c], [x / sum(cells) for x in cells])


def test_votes_and_scores_against_plain_loops():
    rng = random.Random(27)
    words = [*WORDS, "idiot", "you", "trash", "pathetic", "hate", "clown", "!!"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "! "]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "you idiot!! what a clown!! trash!!"]
    lexicons = [np.sort(toxicity._word_hash(v.split())) for v in toxicity.LEXICONS.values()]
    got = toxicity.votes(pa.array(texts), lexicons)
    sets = [set(v.split()) for v in toxicity.LEXICONS.values()]
    second = {"you", "your", "youre", "du", "vous", "tu", "usted"}
    for t, row in zip(texts, got.tolist()):
        w = words_of(t)
        hits = [i for i, x in enumerate(w) if any(x in s for s in sets)]
        want = [int(any(x in s for x in w)) for s in sets]
        want += [int(any(w[j] in second for i in hits for j in range(max(0, i - 4), i))), int(any(b - a <= 25 for a, b in zip(hits, hits[1:]))), int(t.count("!!") >= 3)]
        assert row == want
    weights = np.random.default_rng(3).normal(size=1 << toxicity.BITS)
    slot = lambda x, seed=0: int(toxicity.Words(pa.array([x])).hashes(seed)[0] >> np.uint64(64 - toxicity.BITS))
    for t, p in zip(texts, toxicity.score(pa.array(texts), weights, -0.3)):
        w = set(words_of(t))
        s = -0.3 + sum(weights[slot(x)] for x in w) + sum(weights[slot(x, 7)] for x in {x[: toxicity.STEM] for x in w if len(x) > toxicity.STEM})
        assert abs(p - 1 / (1 + np.exp(-s))) < 1e-9


def test_toxicity_held_out(spark, docs_of):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id for r in toxicity.toxic_documents(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0")).collect()}
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1").collect()
    assert np.mean([r.doc_id in got for r in rest if r.toxic]) > 0.6 and np.mean([r.doc_id in got for r in rest if not r.toxic]) < 0.02


def test_toxicity_awkward(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint")
    assert toxicity.toxic_documents(docs_of([]), none).count() == 0
    assert toxicity.toxic_documents(docs_of(AWKWARD, extra=True), none).count() == 0


# ---- 8

def test_near_duplicates_against_all_pairs(docs_of):
    rng = random.Random(8)
    texts = list(AWKWARD)
    for _ in range(12):
        w = prose(rng, rng.randint(80, 200)).split()
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 6)):
            x = list(w)
            for _ in range(rng.randint(0, len(w) // 14)):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            texts.append(" ".join(x))
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append(set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set()))
    true = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= near_dedup.THRESHOLD}
    docs = docs_of(texts, extra=True)
    group = {r.doc_id: r.group_id for r in near_dedup.duplicate_groups(docs).collect()}
    assert np.mean([i in group and group[i] == group.get(j) for i, j in true]) >= 0.9
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in true:
        parent[root(j)] = root(i)
    assert all(root(d) == root(g) for d, g in group.items())  # nothing is grouped without similar pairs between
    kept = near_dedup.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == {d for d in range(len(texts)) if group.get(d, d) == d} and "fps" in kept.columns
    assert near_dedup.duplicate_groups(docs_of([])).count() == 0


# ---- 9

def test_automaton_equals_regular_expressions():
    rng = random.Random(9)
    rules = ["a[bc]{2,3}d?", "(?:ab|c)+", r"\d{2}x*", "[^a-c]y"]
    trees = [automaton.parse(p) for p in rules]
    text = "".join(rng.choice("abcdxy12 ") for _ in range(4000))
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.arange(0, 4001, 40)
    dfa = automaton.compile_rules(trees, automaton.ALL)
    for lanes in (1, 1000):
        got = {(d, e, r) for d, e, s in automaton.scan(dfa, data, offsets, lanes) for r in dfa.rules[s - dfa.accepting]}
        want = {(d, e, r) for d in range(100) for e in range(1, 41) for r, p in enumerate(rules) for s in range(e) if re.fullmatch(p, text[d * 40 : d * 40 + 40][s:e])}
        assert got == want


def _secret(rng, rule):
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    up = "".join(rng.choice("ABCDEFGHIJ0123") for _ in range(16))
    return {"aws_access_key": "AKIA" + up, "github_token": "ghp_" + (up * 3)[:36], "hex_assignment": f'token = "{hexa}"', "json_web_token": f"eyJ{up}.{up}.{up}", "private_key": "-----BEGIN RSA PRIVATE KEY-----", "basic_auth_url": "https://user:pass@host"}[rule]


def test_secrets_against_regular_expressions(docs_of):
    rng = random.Random(10)
    names = ["aws_access_key", "github_token", "hex_assignment", "json_web_token", "private_key", "basic_auth_url"]
    texts = AWKWARD + [f"é {prose(rng, 5)} {_secret(rng, rng.choice(names))} {prose(rng, 3)} x{_secret(rng, 'aws_access_key')} {_secret(rng, rng.choice(names))}" for _ in range(40)]
    got = {(r.doc_id, r.rule, r.start, r.end) for r in secret_scan.find_secrets(docs_of(texts, extra=True)).collect()}
    want = set()
    for d, t in enumerate(texts):
        for name, p in secret_scan.RULES.items():
            for m in re.finditer(rf"(?<![A-Za-z0-9_-])(?:{p})", t or ""):
                want.add((d, name, m.start(), m.end()))
    assert got == want and len(want) > 60
    assert secret_scan.find_secrets(docs_of([])).count() == 0


def test_secrets_as_they_are_written(docs_of):
    hexa = "0123456789abcdef" * 3
    texts = [f'{{"api_key": "{hexa}"}}', f"db_password = '{hexa}'", "see https://u:p%40ss!@host.com/x", f"accessToken={hexa}", "é" + "AKIA" + "A" * 16, "xAKIA" + "A" * 16]
    got = {r.doc_id: (r.rule, texts[r.doc_id][r.start : r.end]) for r in secret_scan.find_secrets(docs_of(texts)).collect()}
    assert got == {0: ("hex_assignment", f'api_key": "{hexa}'), 1: ("hex_assignment", f"db_password = '{hexa}"), 2: ("basic_auth_url", "https://u:p%40ss!@host"), 3: ("hex_assignment", f"accessToken={hexa}")} | {4: ("aws_access_key", "AKIA" + "A" * 16)}


def test_secrets_take_time_in_proportion():
    rules = tuple(secret_scan.RULES.items())
    secret_scan.automata(rules)
    long = 1 << 20
    for text in ("key=" + "a0" * (long // 2), "key: " * (long // 5), "eyJ" + "abcdefghi." * (long // 10), "token = " + " " * long + "f" * 40, "a://b:" + "c!" * (long // 2)):
        began = time.process_time()
        found = secret_scan.find(pa.array([text]), rules)
        assert time.process_time() - began < 6
        assert [a for _, _, a, _ in found] == [0] * text.startswith(("key=", "eyJ", "token"))


# ---- all

def test_null_ids_repeated_rows_and_clashing_columns(spark):
    """Rows without a doc_id, repeated rows, rows of one doc_id with different texts; ids that are strings; see the docstrings."""
    rng = random.Random(31)
    long = prose(rng, 90)
    rows = [("a", long, "x"), ("a", long, "x"), ("b", long + " more", "y"), (None, long, "z"), (None, long, "z"), ("c", None, "n"), ("d", "", "n"), ("e", "two words", "n"), ("e", "other words", "n"),
            ("f", 'key = "' + "ab" * 20 + '" released under the MIT license.', "n"), ("f", 'key = "' + "ab" * 20 + '" released under the MIT license.', "n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, start string")
    rows_of = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    texts = [r[1] for r in rows]
    enc = _encoding()
    assert rows_of(bpe.encode(docs), "doc_id", "n_tokens") == rows_of(spark.createDataFrame([(d, None if t is None else len(enc.encode_ordinary(t))) for d, t, _ in rows], "doc_id string, n_tokens int"), "doc_id", "n_tokens")
    assert quality.clean(docs).columns == docs.columns
    bench = spark.createDataFrame([("i", long[:200], "q"), ("i", long[:200], "q"), (None, long, "q"), ("j", "two words", "q")], "item_id string, text string, fp string")
    assert {(r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()} == {("a", "i"), ("b", "i"), ("e", "j")}
    assert sorted(r.doc_id or "" for r in decontam.decontaminate(docs, bench).collect()) == ["", "", "c", "d", "f", "f"]
    assert [(r.doc_id, r.license) for r in license_scan.find_licenses(docs).collect()] == [("f", "MIT")] * 2
    assert [(r.doc_id, r.rule) for r in secret_scan.find_secrets(docs).collect()] == [("f", "hex_assignment")] * 2
    assert sorted((r.doc_id, r.n_docs, r.first_doc_id, r.n_words) for r in substring_dedup.repeated_passages(docs).collect()) == [("a", 2, "a", 90), ("b", 2, "a", 90)]
    none = spark.createDataFrame([(None, 1, 1), ("a", None, None)], "doc_id string, quality int, toxic int")
    assert toxicity.toxic_documents(docs, none).count() == 0
    assert {(r.doc_id, r.group_id) for r in near_dedup.duplicate_groups(docs).collect()} == {("a", "a"), ("b", "a")}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or "", (r.text or "")[:5]) for r in kept.collect()) == sorted([("a", long[:5]), ("", long[:5]), ("", long[:5]), ("c", ""), ("d", ""), ("e", "other"), ("f", "key =")])
    lines = line_dedup.dedup_lines(docs, max_docs=1)
    assert lines.count() == len(rows) and lines.columns == docs.columns


# ---- 10

def test_line_dedup(spark, docs_of):
    texts = [f"own {i}.\nShared  LINE\n\nshared line" for i in range(5)] + ["shared line", None, "", "\n\n", "Other"]
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.dedup_lines(docs_of(texts, extra=True), max_docs=5).collect()}
    assert got[0] == ("own 0.\n", 7) and got[5] == ("", 0) and got[6][0] is None and got[8] == ("\n\n", 2) and got[9] == ("Other", 5)
    first = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(texts), max_docs=5, keep_first=True).collect()}
    assert first[0] == texts[0] and first[1] == "own 1.\n"
    assert line_dedup.dedup_lines(docs_of(texts), max_docs=6).where("doc_id = 5").collect()[0].text == "shared line"
    twice = docs_of(texts).union(docs_of(texts)).withColumn("doc_id", F.when(F.col("doc_id") < 9, F.col("doc_id")))
    assert line_dedup.dedup_lines(twice, max_docs=6).count() == 20 and line_dedup.dedup_lines(docs_of([])).count() == 0
