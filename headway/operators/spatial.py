"""Nearest stops and range joins over a grid of cells in space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway import constants as C
from headway.functions.geo import chord, walk_seconds


def _cells(df: DataFrame, prefix: str, size: float, around: bool) -> DataFrame:
    """df with all columns prefixed, and its grid cell: its own, or the 27 around it in as many rows."""
    df = df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])
    for c in "xyz":
        g = F.floor(F.col(prefix + c) / F.lit(size)).cast("bigint")
        df = df.withColumn(f"g{c}", F.explode(F.array(g - 1, g, g + 1)) if around else g)
    return df


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a struct, b struct, d): pairs of rows with x, y, z at most `radius` metres apart. Both sides are dealt to cells of that size; a's
    rows also to the neighbour cells, so pairs meet by an equi-join, at poles and the date line too."""
    met = _cells(a, "a_", radius, True).join(_cells(b, "b_", radius, False), ["gx", "gy", "gz"]).withColumn("d", chord("a_", "b_")).where(F.col("d") <= radius)
    return met.select(*[F.struct(*[F.col(f"`{p}_{c}`").alias(c) for c in df.columns]).alias(p) for p, df in (("a", a), ("b", b))], "d")


def nearby(points: DataFrame, stops: DataFrame, radius: float = C.NEARBY_RADIUS_M, most: int = C.MOST_NEARBY) -> DataFrame:
    """points (query_id, x, y, z) with their stops (stop_id, d), nearest first in rank, at most `most` each."""
    found = within(points, stops, radius).select(F.col("a.query_id").alias("query_id"), F.col("b.stop_id").alias("stop_id"), "d")
    order = Window.partitionBy("query_id").orderBy("d", "stop_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def transfers(stops: DataFrame, radius: float = C.TRANSFER_RADIUS_M) -> DataFrame:
    """(from_stop, to_stop, d, secs) of different stops in walking reach, straight-line."""
    pairs = within(stops, stops, radius).where("a.stop_id <> b.stop_id")
    return pairs.select(F.col("a.stop_id").alias("from_stop"), F.col("b.stop_id").alias("to_stop"), "d", walk_seconds(F.col("d")).alias("secs"))
