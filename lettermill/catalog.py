"""The registered queries of the archive operators and their DuckDB oracles."""

from __future__ import annotations

import lettermill.plans.analysis_queries
import lettermill.plans.card_queries
import lettermill.plans.contact_queries
import lettermill.plans.message_queries
import lettermill.plans.record_queries  # noqa: F401
from lettermill.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "unreplied_inbound"
ORACLE_SQL = ORACLES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "Query"]
