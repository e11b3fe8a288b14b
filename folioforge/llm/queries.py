"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

import importlib

#: One module of this package for each operator, in the operators' order.
MODULES = ("bpe", "quality", "decontam", "chat", "license_scan", "substring_dedup", "toxicity", "near_dedup", "secret_scan", "line_dedup")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"folioforge.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
