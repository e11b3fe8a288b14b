"""All registered queries, after every module that registers some."""

from folioforge.operators import aggregate, corpus, curate, dedup, ingest, links, preserve, render, resolve, scalar, state, wiki  # noqa: F401
from folioforge.operators.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
