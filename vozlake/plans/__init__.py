"""Registered queries: each pairs a Spark job with an independent SQL check."""

from vozlake.plans.registry import ORACLES, QUERIES
from vozlake.plans import (  # noqa: F401 - importing registers the queries
    text_queries, model_queries, metric_queries, routing_queries, cost_queries,
    audit_queries, annotation_queries, report_queries, source_queries, stream_queries, language_queries,
)

__all__ = ["ORACLES", "QUERIES"]
