"""Every registered query of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import factor_queries, kernel_queries, projection_queries, sensing_queries, sketch_queries, sweep_queries  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

FLAGSHIP = "hll_tau_estimate"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
