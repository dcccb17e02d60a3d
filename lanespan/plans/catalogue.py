"""All driver queries of the engine, by name."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE_SQL: dict = {}

for _part in ("q_intervals", "q_segments", "q_phases", "q_rollups", "q_joins", "q_scalars", "q_names", "q_document", "q_sources", "q_checks", "q_streams"):
    _m = importlib.import_module(f"lanespan.plans.{_part}")
    QUERIES |= _m.Q
    ORACLE_SQL |= _m.SQL
