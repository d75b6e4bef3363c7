"""Queries and their DuckDB twins, by name; importing the plan modules fills the catalogue."""

from __future__ import annotations

from rollcall.plans import division_plans, identity_plans, ingest_plans, io_plans, report_plans, scalar_plans, segment_plans, service_plans, source_plans, text_plans  # noqa: F401
from rollcall.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
