"""All registered queries."""

from __future__ import annotations


def load():
    """(queries, oracle SQL) after importing every query module."""
    from flowlens.queries import detect, evaluate, explain, monitor, plans, prepare, registry  # noqa: F401

    return registry.QUERIES, registry.ORACLES
