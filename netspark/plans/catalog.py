"""All registered queries."""

from netspark.plans import (  # noqa: F401
    alert_queries,
    feature_queries,
    graph_queries,
    intel_queries,
    job_queries,
    model_queries,
    outbound_queries,
    signature_queries,
    storage_queries,
    stream_queries,
)
from netspark.plans.registry import QUERIES

__all__ = ["QUERIES"]
