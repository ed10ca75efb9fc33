"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "simple8b", "sharding", "secrets", "jaccard", "decontaminate", "maintext", "pivots", "toxicity", "licences", "simhash", "collocations", "prefixtrie")


def llm_queries():
    """({name: query}, {name: oracle SQL}) of all modules."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"sightline.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
