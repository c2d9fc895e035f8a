"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import catalog, files, kept, library, live, models, records, search

MODULES = (search, records, catalog, library, files, kept, models, live)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
