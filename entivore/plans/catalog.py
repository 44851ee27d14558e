"""The queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from entivore.plans import changes, clients, files, graphs, ingest, lists, passages, profiles, queues, reads, scores, searches, sheets, texts

_PLANS = (scores, graphs, texts, files, queues, lists, changes, ingest, clients, passages, profiles, searches, sheets, reads)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
