"""The queries of the training-data operators."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

for _name in ("mixing", "simhash", "packing", "passages", "quality", "warc", "caps", "neighbours", "token_counts", "language_model"):
    _module = importlib.import_module(f"lanternfish.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
