"""Registry of the llm queries and of their SQL twins."""

from __future__ import annotations

from foldsmith.llm import queries, sql

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
SQL = sql.SQL
