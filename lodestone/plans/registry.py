"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import event_queries, evidence_queries, file_queries, geometry_queries, graph_queries, image_queries, numeric_queries, quality_queries, shape_queries, voxel_queries

FLAGSHIP = "pooled_proportion_by_group"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for part in (evidence_queries, image_queries, graph_queries, shape_queries, event_queries, quality_queries, voxel_queries, numeric_queries, file_queries, geometry_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
