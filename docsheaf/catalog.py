"""All registered queries of the library proper, by operator, with their DuckDB counterparts."""

from __future__ import annotations

from docsheaf.plans import dialogue, evidence, pages, regions, sources, store, telemetry, transcripts

_AREAS = (pages, transcripts, regions, telemetry, store, evidence, dialogue, sources)
QUERIES: dict = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES: dict = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
FLAGSHIP = "c11_drawing_report"
