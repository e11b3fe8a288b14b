"""Fuzzy search for short license notices.

A notice may differ from its text by a bounded number of edits. By the pigeonhole principle a notice cut into one piece
more than the edits allowed has at least one piece unharmed, so exact search for the pieces (one Aho-Corasick pass over
each text for all notices) finds every candidate place. There the ``regex`` library's bounded-error matching verifies
the edits and gives the span. Before that, line breaks with the comment marks after them, and runs of blanks, become one
blank each, so that a notice wrapped in a comment costs no edits; spans are given in the text as it is.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import arrow_rows, table
from folioforge.llm.textblock import pieces

NOTICES = {
    "MIT": "released under the mit license",
    "MIT-permission": "permission is hereby granted, free of charge, to any person obtaining a copy",
    "Apache-2.0": "licensed under the apache license, version 2.0",
    "GPL-3.0": "licensed under the gnu general public license, version 3",
    "GPL-2.0": "licensed under the gnu general public license, version 2",
    "LGPL": "licensed under the gnu lesser general public license",
    "MPL-2.0": "subject to the terms of the mozilla public license, v. 2.0",
    "BSD": "redistribution and use in source and binary forms, with or without modification",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "CC-BY-SA-4.0": "licensed under cc by-sa 4.0",
    "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
    "CC0-1.0": "to the extent possible under law, the author has waived all copyright and related",
    "AGPL-3.0": "licensed under the gnu affero general public license",
    "GPL-notice": "you can redistribute it and/or modify it under the terms of the gnu general public license",
    "Apache-header": "you may not use this file except in compliance with the license",
    "ISC": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
    "EPL-2.0": "made available under the terms of the eclipse public license",
    "BSL-1.0": "distributed under the boost software license, version 1.0",
    "Zlib": "this software is provided 'as-is', without any express or implied warranty",
    "all-rights-reserved": "all rights reserved",
    "Unlicense": "this is free and unencumbered software released into the public domain",
}
#: One edit (a letter put in, left out or replaced) is allowed for so many letters of the notice.
LETTERS_PER_EDIT = 10


def edits(notice: str) -> int:
    return len(notice) // LETTERS_PER_EDIT


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces with their places in the notice."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def _search(notices: tuple[tuple[str, str], ...]):
    pieces_of: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (_, notice) in enumerate(notices):
        e = edits(notice)
        for at, seed in seeds(notice, e):
            pieces_of.setdefault(seed, []).append((i, at))
        patterns.append(regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={e}}}", regex.BESTMATCH))
    automaton = ahocorasick.Automaton()
    for seed, where in pieces_of.items():
        automaton.add_word(seed, (len(seed), where))
    automaton.make_automaton()
    return automaton, patterns


_BLANKS = {ord(c): " " for c in "\n\t\r\u00a0"}


def _lower(text: str, blanks: bool = True) -> str:
    """Lower case of the same length, so that spans hold for the text itself; with ``blanks`` white space of any kind becomes a blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_BLANKS) if blanks else low


#: What becomes one blank: a line break with the blanks around it and the comment marks after it, and blanks in a row.
_GAP = re.compile(r"[ \t]*(?:\r?\n[ \t]*)+(?:[#*;%>|!/-]+[ \t]*(?:\r?\n[ \t]*)*)*|[ \t]{2,}")


def folded(text: str):
    """The text to search in, and the function from its places to those of ``text``."""
    low, starts, moved, parts, at, size = _lower(text, False), [0], [0], [], 0, 0
    for m in _GAP.finditer(low):
        if m.end() - m.start() > 1:
            parts += [low[at : m.start()], " "]
            size += m.start() - at + 1
            at = m.end()
            starts.append(size)
            moved.append(at - size)
    low = (("".join(parts) + low[at:]) if parts else low).translate(_BLANKS)
    return low, (lambda p: p + moved[bisect_right(starts, p) - 1])


def find(text: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, int]]:
    """``(notice, start, end, edits)`` without overlaps.

    Places of a notice whose windows overlap are searched as one window, best match first, and then on both sides of it.
    Where matches of several notices overlap, that of the fewest edits stays, then the longest, then the leftmost, then
    the notice listed first.
    """
    automaton, patterns = _search(notices)
    low, places_of = folded(text)
    places: dict[int, list[tuple[int, int]]] = {}
    for last, (length, where) in automaton.iter(low):
        for i, at in where:
            n, e = len(notices[i][1]), edits(notices[i][1])
            start = last - length + 1 - at
            places.setdefault(i, []).append((max(0, start - e), min(len(low), start + n + e)))
    out = []
    for i, windows in sorted(places.items()):
        windows.sort()
        merged = [list(windows[0])]
        for a, b in windows[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        least = len(notices[i][1]) - edits(notices[i][1])
        todo = [tuple(x) for x in merged]
        while todo:
            a, b = todo.pop()
            if b - a < least:
                continue
            m = patterns[i].search(low, a, b)
            if m is None:
                continue
            out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
            todo += [(a, m.start()), (m.end(), b)]
    best: list[tuple[int, int, int, int]] = []
    out = [(i, places_of(a), places_of(b - 1) + 1, n) for i, a, b, n in out]
    for hit in sorted(out, key=lambda x: (x[3], x[1] - x[2], x[1], x[0])):
        if all(hit[2] <= x[1] or hit[1] >= x[2] for x in best):
            best.append(hit)
    return sorted(best)


def _scan(notices: tuple[tuple[str, str], ...]):
    def run(batches):
        for batch in pieces(batches):
            rows = [(r, *hit) for r, text in enumerate(batch.column("text").to_pylist()) if text for hit in find(text, notices)]
            c = list(zip(*rows)) if rows else [(), (), (), (), ()]
            ids = batch.column("doc_id").take(pa.array(c[0], pa.int64()))
            names = pa.array([notices[i][0] for i in c[1]], pa.string())
            yield pa.RecordBatch.from_arrays([ids, names, *(pa.array(x, pa.int64()) for x in c[2:])], ["doc_id", "license", "start", "end", "edits"])

    return run


def find_licenses(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, start, end, edits)``: character spans of notices within their bound of edits.

    Case, kinds and runs of white space and comment marks at the start of lines don't count. Of licenses whose notices match in one place the best match is reported,
    ties as in ``find``. Null and empty texts give no
    row; rows without a doc_id are reported with a null; repeated rows are reported as often as they occur; whole texts
    are searched; further columns are not looked at; an empty table gives an empty result.
    """
    arrow_rows(docs.sparkSession)
    notices = tuple((notices or NOTICES).items())
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").where("text is not null").mapInArrow(_scan(notices), f"doc_id {kind}, license string, start bigint, end bigint, edits bigint")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES: dict[str, str] = {}
