"""Named queries over the landed tables, with DuckDB-runnable oracle SQL."""

from . import feature_queries, graph_queries, metric_queries, model_queries, rule_queries, sampling_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
