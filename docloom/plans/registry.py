"""Queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from docloom.plans import analysis, search

QUERIES = {**search.QUERIES, **analysis.QUERIES}
SQL = {**search.SQL, **analysis.SQL}
