"""Registered queries of the engine's own operators."""

from __future__ import annotations

from ledgerloom.plans import documents, overviews, pages, reports, retrieval, texts

_MODULES = (retrieval, texts, reports, pages, documents, overviews)


def queries():
    return {name: q[0] for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: q[1] for m in _MODULES for name, q in m.QUERIES.items() if q[1]}
