"""Everything registered: importing the query modules fills the registry."""

from __future__ import annotations

from . import checks_queries, ingest_queries, ledger_queries, sql_queries, sync_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
