"""All registered reports, with the SQL that gives the same rows."""

from __future__ import annotations

from tidewater.plans import bands, basics, details, further, lending, measures, paged, racing, responses, series, venues

PARTS = (lending, series, venues, basics, racing, measures, responses, details, paged, bands, further)

QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
