"""Registered queries and their oracle SQL."""

from __future__ import annotations


def all_queries():
    """(key -> query, key -> oracle SQL) of every family."""
    from sightline.plans import registry, views  # noqa: F401
    from sightline.plans import capture, cluster, spatial, tabular  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLES)
