"""All registered queries and their SQL, by name."""

from __future__ import annotations

from . import oracles, oracles_market, oracles_statistics, oracles_structure, oracles_trading, queries, queries_market, queries_statistics

QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES
assert all(m.ORACLES is ORACLES for m in (oracles_structure, oracles_trading, oracles_statistics, oracles_market)) and all(m.query is queries.query for m in (queries_statistics, queries_market))
