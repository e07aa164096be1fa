"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("ngram_jaccard", "exact_dedup", "suffix_dedup", "quality", "fingerprints", "toxicity", "language_id", "packing", "pii", "bpe")


def _modules():
    present = {p.name for p in __import__("pkgutil").iter_modules(__import__(__package__, fromlist=["x"]).__path__)}
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES if name in present]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
