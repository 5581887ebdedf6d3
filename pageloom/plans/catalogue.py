"""All queries of the library itself, and their DuckDB SQL."""

from __future__ import annotations

from pageloom.plans import annots, content, documents, exchange, feeds, geometry, graph, objects, state, text

FAMILIES = (text, state, graph, annots, geometry, documents, exchange, feeds, content, objects)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
