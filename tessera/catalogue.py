"""Registered queries of the library and, for each that SQL expresses, the same result as DuckDB SQL."""

from __future__ import annotations

from tessera.plans.oracle import ORACLES as _SQL
from tessera.plans.queries import QUERIES as _QUERIES

FLAGSHIP = "rank_topk"
QUERIES = dict(_QUERIES)
ORACLES = {k: v for k, v in _SQL.items() if k in QUERIES}
