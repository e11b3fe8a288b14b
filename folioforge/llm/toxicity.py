"""Toxicity by weak supervision.

Many noisy voters look at a text: lexicons of insults, patterns of abuse and shouting, and, as other languages have other
words, lexicons and word-stem patterns induced from a bounded sample of labelled rows. A generative label model, fitted
to the counts of all vote patterns of the whole corpus without using labels, estimates how accurate each voter is and
which voters are correlated beyond what the hidden label explains; correlated voters are modelled jointly, so that they
aren't counted twice (in groups of up to GROUP). Its posterior labels train a linear classifier on words and word stems, which scores every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_rows, table
from folioforge.llm.near_dedup import shingles
from folioforge.llm.textblock import U, Words, mix, pieces
from folioforge.plans.lineage import shared_table

#: Lexicon voters: each votes "toxic" where one of its words occurs.
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid dumb dumbass imbecile cretin fool retard retarded brainless dimwit halfwit",
    "worth": "worthless pathetic loser losers useless",
    "disgust": "trash scum disgusting filth filthy garbage vermin vile repulsive",
    "mockery": "clown clowns ridiculous laughable buffoon freak weirdo creep",
    "profanity": "fuck fucking fucker shit shitty bitch bastard asshole crap cunt whore slut",
    "threat": "kill murder strangle slaughter",
    "hate": "hate despise loathe subhuman parasites",
}
#: Labelled rows from which lexicons and stems are induced: those of least hash of doc_id, half of them toxic at most.
INDUCTION_ROWS = 6000
#: Documents with posterior labels that train the classifier: those of least hash of doc_id, in each half of the posterior.
TRAINING_ROWS = 8000
STEM = 4
#: Groups into which induced words and stems are dealt, each group a voter.
INDUCED_VOTERS = 3
#: Correlation of two voters within a class, above which they are modelled jointly.
CORRELATED = 0.25
#: Voters in a group that is modelled jointly, at most: its table has 2 ** GROUP entries a class. The strongest correlations are
#: taken first; those that would make a larger group are left out, and their voters count as independent.
GROUP = 4
BITS = 18
THRESHOLD = 0.5


def _word_hash(words: list[str]) -> np.ndarray:
    return Words(pa.array(words, pa.string())).hashes() if words else np.zeros(0, U)


def _stems(w: Words) -> np.ndarray:
    """Hashes of the first STEM letters (by bytes, cut at a letter) of the words that are longer; 0 for the others."""
    padded = np.concatenate([w.data, np.zeros(STEM * 4 + 8, np.uint8)])
    end = w.start.copy()
    for _ in range(STEM):  # a letter is a byte and the continuation bytes after it
        end += 1
        while (more := (padded[end] & 0xC0) == 0x80).any():
            end += more
    ok = end < w.end
    stem = Words.__new__(Words)
    stem.data, stem.start, stem.end = w.data, w.start, np.where(ok, end, w.start + 1)
    return np.where(ok, stem.hashes(7), U(0))


def _distinct(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, hash)`` without repetition."""
    doc = w.docs()
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    new &= x != 0
    return d[new], x[new]


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Distinct word and stem hashes of each text."""
    w = Words(texts)
    d1, x1 = _distinct(w, w.hashes())
    d2, x2 = _distinct(w, _stems(w))
    return np.concatenate([d1, d2]), np.concatenate([x1, x2]), w


def _features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``_features`` of many texts, a slice of them at a time, so that the driver holds little more than the result."""
    docs, hashes, at = [], [], 0
    batch = pa.RecordBatch.from_arrays([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], ["text"])
    for part in pieces([batch], most=1 << 20):
        d, x, _ = _features(part.column("text"))
        docs.append((d + at).astype(np.int32))
        hashes.append(x)
        at += part.num_rows
    return (np.concatenate(docs), np.concatenate(hashes)) if docs else (np.zeros(0, np.int32), np.zeros(0, U))


def thin(texts: pa.Array, hashes: int = 3) -> np.ndarray:
    """Places of the texts that are no near copies of earlier ones: those that share none of a few minhashes of word
    3-grams with a text that is kept. A text copied a thousand times would else pass its every word off as evidence."""
    keep, at = [], 0
    seen: list[set[int]] = [set() for _ in range(hashes)]
    batch = pa.RecordBatch.from_arrays([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], ["text"])
    for part in pieces([batch], most=1 << 20):
        g, lengths = shingles(Words(part.column("text")))
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(lengths).tolist():
            own = g[ends[i] - lengths[i] : ends[i]]
            low = [int(mix(own + U(j + 1)).min()) for j in range(hashes)]
            if not any(x in s for x, s in zip(low, seen)):
                keep.append(at + i)
                for x, s in zip(low, seen):
                    s.add(x)
        at += part.num_rows
    return np.array(keep, np.int64)


def induce(texts: pa.Array, toxic: np.ndarray) -> list[np.ndarray]:
    """INDUCED_VOTERS sorted arrays of hashes of words and stems that occur with toxic labels nearly always, and more often
    than any of so many words would by chance (a binomial tail, by its large deviation bound)."""
    empty = [np.zeros(0, U)] * INDUCED_VOTERS
    at = thin(texts)
    toxic = toxic[at]
    if not len(at) or toxic.all() or not toxic.any():
        return empty
    d, x = _features_of(texts.take(pa.array(at)))
    keys, at = np.unique(x, return_inverse=True)
    pos = np.bincount(at, toxic[d].astype(float), len(keys))
    n = np.bincount(at, minlength=len(keys)).astype(float)
    rate, share = toxic.mean(), np.minimum(pos / n, 1 - 1e-9)
    chance = n * (share * np.log(np.maximum(share, 1e-9) / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    chosen = keys[(n >= 3) & (share > 0.9) & (share > rate) & (chance > np.log(max(1, (n >= 3).sum())))]
    return [np.sort(chosen[mix(chosen) % U(INDUCED_VOTERS) == U(i)]) for i in range(INDUCED_VOTERS)]


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def votes(texts: pa.Array, lexicons: list[np.ndarray]) -> np.ndarray:
    """One row of 0 and 1 for each text: the lexicons, then the pattern voters (an insult after "you", two insults near each other, shouting)."""
    w = Words(texts)
    h, s, doc, n = w.hashes(), _stems(w), w.docs(), len(texts)
    out = np.zeros((n, len(lexicons) + 3), np.int8)
    any_of = np.zeros(len(h), bool)
    for i, x in enumerate(lexicons):
        found = _member(h, x) | (_member(s, x) if i >= len(LEXICONS) else False)
        out[doc[found], i] = 1
        any_of |= found
    you = _member(h, np.sort(_word_hash(["you", "your", "youre", "du", "vous", "tu", "usted"])))
    at = np.flatnonzero(any_of)
    for back in range(1, 5):
        b = at - back
        ok = b >= 0
        ok[ok] = you[b[ok]] & (doc[b[ok]] == doc[at[ok]])
        out[doc[at[ok]], -3] = 1
    near = np.flatnonzero((at[1:] - at[:-1] <= 25) & (doc[at[1:]] == doc[at[:-1]])) if len(at) > 1 else np.zeros(0, np.int64)
    out[doc[at[near]], -2] = 1
    shout = pc.count_substring(pc.fill_null(texts, ""), "!!").to_numpy(zero_copy_only=False)
    out[shout >= 3, -1] = 1
    return out


class LabelModel:
    """Two hidden classes; voters in groups, each group a table P(votes of the group | class); fitted by EM on pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        self.m = patterns.shape[1] if patterns.ndim == 2 else 0
        self.groups = [[i] for i in range(self.m)]
        self.correlations: list[tuple[int, int, float]] = []
        self._fit(patterns, counts, rounds)
        self._correlate(patterns, counts)
        if self.correlations:
            self._fit(patterns, counts, rounds)

    def _codes(self, patterns: np.ndarray) -> list[np.ndarray]:
        return [patterns[:, g].astype(np.int64) @ (1 << np.arange(len(g))) for g in self.groups]

    def _fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int) -> None:
        total = counts.sum()
        if not total:
            self.prior, self.tables = 0.0, [np.full((2, 1 << len(g)), 0.5) for g in self.groups]
            return
        codes = self._codes(patterns)
        fired = patterns.sum(1)
        post = np.where(fired > 0, np.minimum(0.95, 0.55 + 0.15 * fired), 0.02)  # a text with votes is more likely toxic
        for _ in range(rounds):
            self.prior = float(np.clip((post * counts).sum() / total, 1e-4, 0.5))
            self.tables = []
            for c, g in zip(codes, self.groups):
                k = 1 << len(g)
                t = np.stack([np.bincount(c, counts * (1 - post), k), np.bincount(c, counts * post, k)]) + 0.5
                self.tables.append(t / t.sum(1, keepdims=True))
            new = self.posterior(patterns)
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        score = np.log(max(self.prior, 1e-9)) - np.log1p(-self.prior) + np.zeros(len(patterns))
        for c, t in zip(self._codes(patterns), self.tables):
            score += np.log(t[1, c]) - np.log(t[0, c])
        return 1 / (1 + np.exp(-score))

    def accuracies(self) -> np.ndarray:
        """``(P(vote | toxic), P(vote | not toxic))`` of each voter."""
        out = np.zeros((self.m, 2))
        for g, t in zip(self.groups, self.tables):
            for j, i in enumerate(g):
                bit = (np.arange(t.shape[1]) >> j) & 1
                out[i] = (t[1] * bit).sum(), (t[0] * bit).sum()
        return out

    def _correlate(self, patterns: np.ndarray, counts: np.ndarray) -> None:
        if not counts.sum():
            return
        post = self.posterior(patterns)
        parent = list(range(self.m))
        pairs = {}
        for weight in (counts * post, counts * (1 - post)):
            if weight.sum() < 20:
                continue
            x = patterns - (patterns * weight[:, None]).sum(0) / weight.sum()
            cov = (x * weight[:, None]).T @ x / weight.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            for i, j in np.argwhere(np.triu(np.abs(cov / np.outer(sd, sd)) > CORRELATED, 1)):
                pairs[int(i), int(j)] = max(pairs.get((int(i), int(j)), 0.0), float(abs(cov[i, j] / sd[i] / sd[j])))
        size = [1] * self.m
        for (i, j), c in sorted(pairs.items(), key=lambda p: -p[1]):
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            if i != j and size[i] + size[j] <= GROUP:
                parent[j], size[i] = i, size[i] + size[j]
        self.correlations = [(i, j, c) for (i, j), c in pairs.items()]
        roots: dict[int, list[int]] = {}
        for i in range(self.m):
            r = i
            while parent[r] != r:
                r = parent[r]
            roots.setdefault(r, []).append(i)
        self.groups = list(roots.values())


def train_linear(texts: pa.Array, target: np.ndarray, prior: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of 2^BITS hashed words and stems, and intercept: logistic regression on posterior labels, with words that
    don't tell the halves apart (|z| < 4) left out. The intercept is set back from the sample's rate to ``prior``."""
    weights, bias = np.zeros(1 << BITS), -3.0
    at = thin(texts) if len(texts) else np.zeros(0, np.int64)
    texts, target = texts.take(pa.array(at)), target[at]
    if not len(at) or target.max() < 0.5:
        return weights, bias
    d, x = _features_of(texts)
    slot = (x >> U(64 - BITS)).astype(np.int32)
    del x
    p = np.bincount(slot, target[d], 1 << BITS)
    n = np.bincount(slot, minlength=1 << BITS).astype(float)
    rate = target.mean()
    z = (p - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))
    use = (n >= 3) & (np.abs(z) > 4)
    keep = use[slot]
    d, slot = d[keep], slot[keep]
    names, slot = np.unique(slot, return_inverse=True)
    w, b, vw, vb = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    for t in range(rounds):  # full gradient with per-weight step sizes
        s = np.bincount(d, w[slot], len(texts)) + b
        g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - target
        gw, gb = np.bincount(slot, g[d], len(names)) + 0.05 * w, g.sum()
        vw, vb = vw + gw * gw, vb + gb * gb
        w -= 0.5 * gw / np.sqrt(vw + 1e-9)
        b -= 0.5 * gb / np.sqrt(vb + 1e-9)
    weights[names] = w
    odds = lambda p: np.log(p) - np.log1p(-p)
    return weights, float(b + odds(np.clip(prior, 1e-4, 0.5)) - odds(np.clip(rate, 1e-4, 1 - 1e-4)))


def score(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    d, x, _ = _features(texts)
    s = np.bincount(d, weights[(x >> U(64 - BITS)).astype(np.int64)], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _code(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (1 << np.arange(v.shape[1]))


def _voted(shared):
    def run(batches):
        for batch in pieces(batches):
            code = _code(votes(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(code)], ["doc_id", "votes"])

    return run


def _scored(shared):
    def run(batches):
        for batch in pieces(batches):
            code, (weights, bias) = votes(batch.column("text"), shared.value[0]), shared.value[1]
            p = score(batch.column("text"), weights, bias)
            at = pa.array(np.flatnonzero(p >= THRESHOLD))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(p).take(at), pa.array(_code(code)).take(at)], ["doc_id", "p_toxic", "votes"])

    return run


def _sample(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least hash of doc_id, ties by doc_id."""
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], LabelModel, tuple[np.ndarray, float]]:
    """Lexicons of all voters, the label model, the classifier."""
    spark = docs.sparkSession
    arrow_rows(spark)
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic")).where("__id is not null and toxic is not null").dropDuplicates(["__id"])
    parts = [_sample(known.where(F.col("toxic") == t).withColumnRenamed("__id", "doc_id"), INDUCTION_ROWS // 2).withColumnRenamed("doc_id", "__id") for t in (1, 0)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # INDUCTION_ROWS rows at most
    rows = texts.join(chosen, texts["doc_id"] == chosen["__id"]).select("doc_id", "text", "toxic").orderBy("doc_id", "text").toArrow()
    toxic = np.array(rows.column("toxic").to_pylist(), float) > 0.5
    lexicons = [np.sort(_word_hash(v.split())) for v in LEXICONS.values()] + induce(rows.column("text"), toxic)
    m = len(lexicons) + 3

    voted = texts.mapInArrow(_voted(spark.sparkContext.broadcast(lexicons)), f"doc_id {dict(docs.dtypes)['doc_id']}, votes bigint")
    voted = shared_table(voted, "votes")  # read by the counts and both samples
    found = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2^voters rows, however large the corpus
    codes = np.array(sorted(r["votes"] for r in found), np.int64)
    n = {r["votes"]: r["n"] for r in found}
    patterns = ((codes[:, None] >> np.arange(m)) & 1).astype(np.int8) if len(codes) else np.zeros((0, m), np.int8)
    model = LabelModel(patterns, np.array([n[c] for c in codes.tolist()], float))
    post = dict(zip(codes.tolist(), model.posterior(patterns).tolist())) if len(codes) else {}

    high = [c for c, p in post.items() if p >= 0.5]
    halves = [voted.where(F.col("votes").isin(high) if side else ~F.col("votes").isin(high)) for side in (True, False)] if high else [voted]
    drawn = [_sample(h, TRAINING_ROWS // 2) for h in halves]
    picked = drawn[0].union(drawn[1]) if len(drawn) > 1 else drawn[0]
    picked = F.broadcast(picked.select(F.col("doc_id").alias("__id"), "votes").dropDuplicates(["__id"]))
    train = texts.join(picked, texts["doc_id"] == picked["__id"]).select("doc_id", "text", "votes").orderBy("doc_id", "text").toArrow()
    target = np.array([post[v] for v in train.column("votes").to_pylist()], float)
    return lexicons, model, train_linear(train.column("text"), target, model.prior)


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, p_toxic, votes)`` of the documents that the classifier finds toxic (probability of THRESHOLD or more);
    ``votes`` has a bit for each voter, in the order of LEXICONS, induced voters, patterns.

    Null texts are never toxic; empty ones get the intercept's probability. Rows without a doc_id are scored but take no
    part in fitting; repeated rows are each scored. Without labels the induced voters never vote; where no voter ever
    votes nothing is toxic. Whole texts are scored; further columns are not looked at; an empty table gives an empty
    result.
    """
    lexicons, _, linear = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((lexicons, linear))
    return docs.select("doc_id", "text").where("text is not null").mapInArrow(_scored(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, p_toxic double, votes bigint")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
