"""Nearby stops for a stream of requests: a stream joined to the stop table, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway import constants as C
from headway.functions.geo import with_cartesian
from headway.operators.spatial import within


def nearby_stream(requests: DataFrame, stops: DataFrame, radius: float = C.NEARBY_RADIUS_M) -> DataFrame:
    """requests: a stream of (query_id, lat, lon). (query_id, stop_id, d) for all stops in reach."""
    return within(with_cartesian(requests), stops, radius).select(F.col("a.query_id").alias("query_id"), F.col("b.stop_id").alias("stop_id"), "d")
