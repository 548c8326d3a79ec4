"""All queries over the given tables, and their DuckDB SQL."""

from . import domain_queries, evaluate_queries, incident_queries, monitor_queries, prepare_queries, source_queries, structure_queries, window_queries  # noqa: F401
from . import stream_queries  # noqa: F401  (its SQL is that of the batch twins)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
