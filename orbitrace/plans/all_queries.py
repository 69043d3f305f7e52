"""All registered queries."""

from __future__ import annotations

from orbitrace.plans import field_queries, geometry_queries, more_queries, sink_queries, stream_queries, track_queries  # noqa: F401  registration
from orbitrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
