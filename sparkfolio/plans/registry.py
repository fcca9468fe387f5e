"""All registered queries with their SQL."""

from __future__ import annotations

from . import analytics, compliance, formats, learning, oracle, queries, resampling, storage, stores

_PARTS = (resampling, analytics, compliance, formats, learning, storage, stores)
QUERIES = queries.QUERIES | {k: f for part in _PARTS for k, (f, _) in part.TABLE.items()}
ORACLE = oracle.ORACLE | {k: sql for part in _PARTS for k, (_, sql) in part.TABLE.items() if sql}
