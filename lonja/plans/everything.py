"""All registered queries of the library and their SQL."""

from __future__ import annotations

from lonja.plans import checks, edits, gates, inheritance, layout, matching, names, orders, registry, remediation, tariffs

_PARTS = (registry, orders, checks, edits, gates, remediation, matching, layout, inheritance, tariffs, names)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
