"""Registry of the queries outside the llm subpackage and of their SQL twins."""

from __future__ import annotations

from foldsmith.plans import boxes, checks, content, curves, folds, nearby, roundtrips, similarity

QUERIES = {**content.QUERIES, **boxes.QUERIES, **similarity.QUERIES, **folds.QUERIES, **curves.QUERIES, **checks.QUERIES, **nearby.QUERIES, **roundtrips.QUERIES}
SQL = {**content.SQL, **boxes.SQL, **similarity.SQL, **folds.SQL, **curves.SQL, **checks.SQL, **nearby.SQL, **roundtrips.SQL}
