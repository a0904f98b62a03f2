"""All queries outside the llm subpackage."""

from __future__ import annotations

from . import aggregate_queries, cluster_queries, extra_queries, feature_queries, gate_queries, geometry_queries, join_queries, live_queries, registry, source_queries, stream_queries, training, window_queries

__all__ = ["aggregate_queries", "cluster_queries", "extra_queries", "feature_queries", "gate_queries", "geometry_queries", "join_queries", "live_queries", "oracle_sql", "queries", "source_queries", "stream_queries", "window_queries"]


def queries():
    return dict(registry.QUERIES) | training.QUERIES


def oracle_sql():
    return dict(registry.ORACLE) | training.ORACLE
