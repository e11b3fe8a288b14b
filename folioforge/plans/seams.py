"""Where code from outside plugs in: extraction, synthesis, curation. The engine itself never calls a model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


def retry_with_feedback(run: Callable[[list[str]], Any], check: Callable[[Any], list[str]], attempts: int = 3) -> tuple[Any, int, list[str]]:
    """``run(feedback)`` until ``check`` finds nothing, at most ``attempts`` times: (result, attempts made, findings left)."""
    feedback: list[str] = []
    for n in range(1, attempts + 1):
        result = run(feedback)
        feedback = check(result)
        if not feedback:
            return result, n, []
    return result, attempts, feedback


class SeamFailure(Exception):
    """What outside code raises when its own call fails (no connection, no answer): only this counts as a failed call. Any other
    exception is a fault in that code and ends the job."""


def extract(chunks: DataFrame, reply: Callable[[str, str], str], tasks: int | None = None, stagger_s: float = 0.0) -> DataFrame:
    """``(chunk_id, reply)``: the extractor's answer for each chunk(chunk_id, body); ``tasks`` bounds the calls at once, and task
    ``k`` starts ``k * stagger_s`` later. The first call that raises ends the job, as Spark gives a task up (``spark.task.maxFailures``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if stagger_s:
            time.sleep(TaskContext.get().partitionId() % max(tasks or 1, 1) * stagger_s)
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "reply": [reply(c, b) for c, b in zip(pdf["chunk_id"], pdf["body"])]})

    df = chunks.select("chunk_id", "body")
    return (df.repartition(tasks) if tasks else df).mapInPandas(run, "chunk_id string, reply string")


@dataclass
class Modes:
    """Page writers in the order tried. Each takes (data, feedback); ``check`` sees the raw page, before anything is enforced."""

    strict: Callable[[str, list[str]], str]
    permissive: Callable[[str, list[str]], str]
    template: Callable[[str], str]
    check: Callable[[str, str], list[str]]


def synthesize(pages: DataFrame, modes: Modes, tasks: int = 4, attempts: int = 3) -> DataFrame:
    """``(path, page, mode, attempts, findings)`` of pages(path, data): strict, else permissive, else the template.

    A writer that raises ``SeamFailure`` counts as a failed mode; ``tasks`` bounds the calls at once.
    """
    def one(path: str, data: str) -> tuple:
        total = 0
        for mode, write in (("strict", modes.strict), ("permissive", modes.permissive)):
            try:
                page, n, left = retry_with_feedback(lambda f: write(data, f), lambda p: modes.check(data, p), attempts)
            except SeamFailure:
                total += 1
                continue
            total += n
            if not left:
                return path, page, mode, total, 0
        return path, modes.template(data), "template", total, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(p, d) for p, d in zip(pdf["path"], pdf["data"])], columns=["path", "page", "mode", "attempts", "findings"])

    return pages.select("path", "data").repartition(tasks).mapInPandas(run, "path string, page string, mode string, attempts int, findings int")


def curate(candidates: DataFrame, judge: Callable[[list[dict]], str]) -> list[tuple[int, str]]:
    """``(bucket, reply)``: each bucket of candidates (at most MAX_ROWS rows) goes to the judge; one that raises ``SeamFailure`` keeps all.

    One job streams the rows in order, a partition at a time, and only one bucket's are held.
    """
    rows = candidates.orderBy("bucket", "slug").toLocalIterator()
    out = []
    for b, group in groupby(rows, key=lambda r: r["bucket"]):
        try:
            out.append((b, judge([r.asDict(recursive=True) for r in group])))
        except SeamFailure:
            out.append((b, '{"merges": [], "drops": []}'))
    return out


def write_indexes(folders: DataFrame, write: Callable[[str, str, list[str]], str], check: Callable[[str, str], list[str]], tasks: int = 4, attempts: int = 3) -> DataFrame:
    """``(folder, body, written)`` of folders(folder, body): a writer's text of each folder index, or the given one where the writer
    doesn't pass ``check`` or raises ``SeamFailure``. Of ``render.write_order`` one level is written at a time."""
    def one(folder: str, body: str) -> tuple:
        try:
            text, _, left = retry_with_feedback(lambda f: write(folder, body, f), lambda t: check(body, t), attempts)
        except SeamFailure:
            return folder, body, False
        return (folder, body, False) if left else (folder, text, True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(f, b) for f, b in zip(pdf["folder"], pdf["body"])], columns=["folder", "body", "written"])

    return folders.select("folder", "body").repartition(tasks).mapInPandas(run, "folder string, body string, written boolean")


def propose(current: str, write: Callable[[str], str], ok: Callable[[str], bool]) -> str:
    """A workspace's prose or a guide, made anew by ``write``; the current one where that fails or isn't good enough."""
    try:
        new = write(current)
    except SeamFailure:
        return current
    return new if ok(new) else current


def curate_in_rounds(candidates: DataFrame, judge: Callable[[list[dict]], str], survivors: Callable[[list[tuple[int, str]]], DataFrame]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Replies of two rounds: the buckets by themselves, then, if there was more than one, what survived of them (``survivors``
    gives it from the replies, bucketed again), so that candidates of different buckets meet once."""
    first = curate(candidates, judge)
    return first, curate(survivors(first), judge) if len(first) > 1 else []
