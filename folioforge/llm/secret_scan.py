"""Secret scan with one combined automaton for all rules.

All rule expressions become one minimal deterministic automaton over bytes (see ``automaton``), which passes once over
each text and comes to an accepting state wherever a secret of any rule ends. In the few texts where it does, the rule's
own automaton runs from all places where a secret may start, side by side, until none is left: most end with their first
byte, and a long secret has one start, so the time is in proportion to the text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.automaton import ALL, Dfa, compile_rules, parse, scan
from folioforge.llm.common import arrow_rows, table
from folioforge.llm.textblock import buffers, pieces

_VALUE = r"""["']?[ \t]*[:=][ \t]*["']?"""
_NAMES = "api access auth client secret db database user app admin root private session signing encryption master service my".split()
_PREFIXES = "|".join([f"[{x[0].upper()}{x[0]}]{x[1:]}" for x in _NAMES] + [x.upper() for x in _NAMES])
RULES = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36}",
    "gitlab_token": r"glpat-[0-9A-Za-z_-]{20}",
    "slack_token": r"xox[abprs]-[0-9A-Za-z-]{10,48}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[rs]k_live_[0-9A-Za-z]{24}",
    "npm_token": r"npm_[0-9A-Za-z]{36}",
    "json_web_token": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----",
    "hex_assignment": r"(?:(?:" + _PREFIXES + r")[_-]?)?(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD|[Pp]asswd|PASSWD)" + _VALUE + r"[0-9a-fA-F]{32,}",
    "basic_auth_url": r"[a-z]+://[A-Za-z0-9_.%~-]+:[A-Za-z0-9_.%~!$&+-]+@[A-Za-z0-9-]+",
}
#: A secret starts a text or follows one of these bytes; so no rule can start inside the run of another's token.
BOUNDARY = ALL - frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")


@functools.lru_cache(maxsize=2)
def automata(rules: tuple[tuple[str, str], ...]) -> tuple[Dfa, list[Dfa]]:
    trees = [parse(p) for _, p in rules]
    return compile_rules(trees, BOUNDARY), [compile_rules([t], None) for t in trees]


_STARTS = np.isin(np.arange(256), list(BOUNDARY))


def _spans(rule: Dfa, text: np.ndarray) -> list[list[int]]:
    """``[start, end]`` of the longest match from each place where the rule can start, merged where they overlap."""
    at = np.flatnonzero(np.concatenate([[True], _STARTS[text[:-1]]])) if len(text) else np.zeros(0, np.int64)
    klass, table, width = rule.klass[text], rule.table, rule.n_classes
    state, end, alive, step = np.full(len(at), rule.start, np.int64), np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(alive) > 8:
        state[alive] = now = table[state[alive] * width + klass[at[alive] + step]]
        step += 1
        end[alive[now >= rule.accepting]] = step
        alive = alive[(now != rule.dead) & (at[alive] + step < len(text))]
    if len(alive):
        flat, letters = table.tolist(), klass
        for x in alive.tolist():  # the last few by themselves, a slice of the text at a time
            s, j = int(state[x]), int(at[x]) + step
            while s != rule.dead and j < len(text):
                for c in letters[j : j + 4096].tolist():
                    s = flat[s * width + c]
                    j += 1
                    if s >= rule.accepting:
                        end[x] = j - at[x]
                    if s == rule.dead:
                        break
    out: list[list[int]] = []
    for a, n in zip(at[end > 0].tolist(), end[end > 0].tolist()):
        if out and out[-1][1] > a:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return out


def find(texts: pa.Array, rules: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, int]]:
    """``(document, rule, start byte, end byte)``: the union of all matches of a rule, as maximal spans."""
    combined, single = automata(rules)
    data, offsets = buffers(texts)
    found = sorted({(doc, rule) for doc, _, state in scan(combined, data, offsets, ends=False) for rule in combined.rules[state - combined.accepting]})
    return [(doc, rule, a, b) for doc, rule in found for a, b in _spans(single[rule], data[offsets[doc] : offsets[doc + 1]])]


def _scan(rules: tuple[tuple[str, str], ...]):
    def run(batches):
        for batch in pieces(batches, most=16 << 20):
            texts = batch.column("text")
            out, last, at, chars, raw = [], -1, 0, 0, b""
            for doc, rule, a, b in sorted(find(texts, rules), key=lambda x: (x[0], x[2], x[1], x[3])):
                if doc != last:
                    last, at, chars, raw = doc, 0, 0, texts[doc].as_py().encode()
                chars, at = chars + len(raw[at:a].decode("utf-8", "ignore")), a
                start, secret = chars, raw[a:b].decode("utf-8", "replace")
                out.append((doc, rules[rule][0], start, start + len(secret), secret))
            columns = list(zip(*out)) if out else [(), (), (), (), ()]
            ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())], ["doc_id", "rule", "start", "end", "secret"])

    return run


def find_secrets(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, rule, start, end, secret_sha256)``: character spans of secrets, without the secrets themselves.

    Overlapping matches of one rule give one span; different rules report each their own. Null and empty texts give no
    row; rows without a doc_id are reported with a null; repeated rows are reported as often as they occur; further
    columns are not looked at; texts may be of any length; an empty table gives an empty result.
    """
    arrow_rows(docs.sparkSession, 5000)
    rules = tuple((rules or RULES).items())
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").where("text is not null").mapInArrow(_scan(rules), f"doc_id {kind}, rule string, start bigint, end bigint, secret string")
    return found.select("doc_id", "rule", "start", "end", F.sha2("secret", 256).alias("secret_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
