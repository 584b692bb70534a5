"""All queries of the core and their SQL."""

from __future__ import annotations

from paperloom.plans import evaluation, extras, graphs, identity, retrieval, scoring, shredding, streams

FLAGSHIP = "flt_pass"
_PARTS = (identity, scoring, evaluation, graphs, retrieval, streams, extras)
QUERIES = {**shredding.QUERIES, **{k: f for part in _PARTS for k, f in part.query.queries.items()}}
ORACLE = {**shredding.ORACLE, **{k: s for part in _PARTS for k, s in part.query.oracle.items()}}
