"""DuckDB oracles of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}
