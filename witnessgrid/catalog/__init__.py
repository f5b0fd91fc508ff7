"""Queries over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ("evidence_queries", "semantic_queries", "evaluation_queries", "source_queries", "state_queries")


def load():
    from .registry import REGISTRY

    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return dict(REGISTRY)
