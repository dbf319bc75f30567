"""Queries over the driver tables, with SQL twins."""

from . import aggregate_queries, association_queries, cluster_queries, diagnostic_queries, fit_queries, geometry_queries, graph_queries, join_queries, mesh_queries, solid_queries, source_queries, stream_queries, window_queries
from .registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "aggregate_queries", "association_queries", "cluster_queries", "diagnostic_queries", "fit_queries", "geometry_queries", "graph_queries", "join_queries", "mesh_queries", "solid_queries", "source_queries", "stream_queries",
    "window_queries",
]
