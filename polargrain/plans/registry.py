"""Names of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

from polargrain.plans import queries_client, queries_eval, queries_grid, queries_image, queries_io

_PARTS = (queries_grid, queries_image, queries_eval, queries_io, queries_client)
QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
