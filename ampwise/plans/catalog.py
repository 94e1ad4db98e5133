"""All registered queries."""

from ampwise.plans import (  # noqa: F401  (registers on import)
    learning_queries,
    metric_queries,
    segment_queries,
    store_queries,
    stream_queries,
    synthetic_queries,
)
from ampwise.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
