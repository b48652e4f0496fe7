"""Named queries over the driver tables, each paired with a DuckDB oracle."""

from riskframe.plans import (  # noqa: F401  (each module registers its queries)
    maintenance_queries, monitoring_queries, portfolio_queries, prep_queries, stateful_queries,
    ml_queries, retrieval_queries, text_queries, stream_queries, function_queries, audit_queries)
from riskframe.plans.catalog import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
