"""All queries of the library, and their SQL."""

from __future__ import annotations

from freshet.plans import basins, queries, rasters, shapes, terrain

PARTS = (queries, terrain, shapes, basins, rasters)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
