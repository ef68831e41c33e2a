"""Imports every module of queries, so that the registry is complete."""

from lorespark.plans import graph_queries, kernel_queries, metrics_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from lorespark.plans.registry import ORACLES, QUERIES  # noqa: F401
