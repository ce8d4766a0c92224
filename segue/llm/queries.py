"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["licenses", "quality", "minhash", "packing", "embeddings", "sharding", "language", "line_dedup", "bpe_codec", "quality_rules",
           "periodic", "mixing", "spelling"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"segue.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
