"""Line differences by longest common subsequence, in hunks with context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def line_diff(old: str, new: str) -> list[tuple[str, str]]:
    """``(mark, line)`` with mark ' ', '-' or '+'; where both are as good, a removal comes first."""
    a, b = old.split("\n"), new.split("\n")
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    ids = {x: i for i, x in enumerate(dict.fromkeys(a + b))}
    y = np.array([ids[x] for x in b], np.int64)
    for i in range(n - 1, -1, -1):
        down, hit = best[i + 1], y == ids[a[i]]
        take = np.where(hit, down[1:] + 1, down[:-1])
        best[i, :m] = np.maximum.accumulate(take[::-1])[::-1] if m else take  # a row's best only falls to the right
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1, j] >= best[i, j + 1]):
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out


def hunks(diff: list[tuple[str, str]], context: int = 2) -> list[list[tuple[str, str]]]:
    """Changed lines with ``context`` lines around them; neighbours that touch are one hunk."""
    near = sorted({k for i, (mark, _) in enumerate(diff) if mark != " " for k in range(max(0, i - context), min(len(diff), i + context + 1))})
    out: list[list[tuple[str, str]]] = []
    for n, k in enumerate(near):
        if not n or near[n - 1] != k - 1:
            out.append([])
        out[-1].append(diff[k])
    return out


def diff_column(old: Column, new: Column) -> Column:
    """The hunks as text, by a pandas UDF: the dynamic programme has no relational form."""
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n...\n".join("\n".join(m + x for m, x in h) for h in hunks(line_diff(p or "", q or ""))) for p, q in zip(a, b)])

    return run(old, new)
