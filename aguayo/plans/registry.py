"""All queries of the core with their SQL."""

from __future__ import annotations

from . import problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
SQL = {**problems.SQL, **reference.SQL}
