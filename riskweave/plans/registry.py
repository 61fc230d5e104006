"""All queries of the engine, and DuckDB SQL for those that SQL can express."""

from riskweave.plans import queries_extra, queries_layers, queries_more, queries_network, queries_risk  # noqa: F401  they register their queries
from riskweave.plans.queries_core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
