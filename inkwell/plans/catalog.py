"""All queries of the package's own operators and their SQL, by name."""

from __future__ import annotations

from . import accounts, blocks, documents, exports, extraction, formatting, formulas, pagination, repair, streams, structure, structured, wordfixing, wordlayout

MODULES = (accounts, documents, structure, extraction, structured, blocks, repair, streams, wordlayout, formulas, formatting, pagination, exports, wordfixing)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
