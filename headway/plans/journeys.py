"""Journey planning for batches of requests: access, search, choice, legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway import constants as C
from headway.functions.geo import access_seconds, with_cartesian
from headway.operators.raptor import pick_itineraries, search, unwind
from headway.operators.spatial import nearby
from headway.plans.lineage import cut
from headway.sources.timetable import Timetable


def parse_requests(bodies: DataFrame, now_s: int | None = None) -> DataFrame:
    """bodies: (query_id, body), plan requests as JSON. (query_id, from_lat, from_lon, to_lat, to_lon, start_t, end_t, transfer_mode, max_transfers): times in
    whole seconds; without any the request starts now; the mode is walking and transfers are unlimited where left out, and never above
    MOST_TRANSFERS."""
    place = "STRUCT<lat DOUBLE, lon DOUBLE>"
    r = F.from_json("body", f"`from` {place}, `to` {place}, start_at BIGINT, end_at BIGINT, transfer_mode STRING, max_transfers BIGINT")
    parsed = bodies.select("query_id", r.alias("r"))
    seconds = lambda c: F.expr(f"r.{c} div 1000")
    now = F.unix_timestamp() if now_s is None else F.lit(now_s)
    start = F.coalesce(seconds("start_at"), F.when(F.col("r.end_at").isNull(), now)).cast("bigint")
    return parsed.select("query_id", *[F.col(f"r.{e}.{c}").alias(f"{e}_{c}") for e in ("from", "to") for c in ("lat", "lon")], start.alias("start_t"), seconds("end_at").alias("end_t"), F.coalesce("r.transfer_mode", F.lit("walking")).alias("transfer_mode"), F.least(F.coalesce("r.max_transfers", F.lit(C.MOST_TRANSFERS)), F.lit(C.MOST_TRANSFERS)).cast("bigint").alias("max_transfers"))


def access(requests: DataFrame, stops: DataFrame, lat: str, lon: str) -> DataFrame:
    """(query_id, stop_id, cost) of the stops that a request's end can walk to."""
    points = with_cartesian(requests.select("query_id", F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    return nearby(points, stops, C.ACCESS_RADIUS_M, C.MOST_ACCESS_STOPS).select("query_id", "stop_id", access_seconds(F.col("d")).alias("cost"))


def _pruning(targets: DataFrame) -> DataFrame:
    """Targets with the largest scaled cost: what can't beat an arrival with that can't be picked under any scalar."""
    return targets.select("query_id", "stop_id", F.floor(F.col("cost") * max(C.WALK_SCALARS)).alias("cost"))


def depart_at(requests: DataFrame, tt: Timetable, transfers: DataFrame, rounds: int = C.MOST_TRANSFERS - 1, delta: int = C.ROUND_DELTA, one_per_line: bool = False, horizon: int | None = None) -> tuple[DataFrame, DataFrame]:
    """requests: (query_id, from_lat, from_lon, to_lat, to_lon, start_t). Itineraries as pick_itineraries() gives them, and their legs."""
    start = access(requests, tt.stops, "from_lat", "from_lon").join(requests.select("query_id", "start_t"), "query_id").select("query_id", "stop_id", (F.col("start_t") + F.col("cost")).alias("t"))
    targets = cut(access(requests, tt.stops, "to_lat", "to_lon"))
    labels = search(start, tt.stop_times, transfers, rounds, one_per_line=one_per_line, bound=_pruning(targets), delta=delta, horizon=horizon)
    picked = cut(pick_itineraries(labels, targets, C.WALK_SCALARS, rounds, delta))
    return picked, unwind(picked, labels, rounds)


def arrive_by(requests: DataFrame, tt: Timetable, transfers: DataFrame, rounds: int = C.MOST_TRANSFERS - 1, delta: int = C.ROUND_DELTA, horizon: int | None = None) -> tuple[DataFrame, DataFrame]:
    """requests with end_t instead of start_t: for each round the latest departure from a stop near the start, its walk taken off, if it
    beats earlier rounds. (query_id, round, stop_id, t, leave_t, rank), and the legs."""
    end = access(requests, tt.stops, "to_lat", "to_lon").join(requests.select("query_id", "end_t"), "query_id").select("query_id", "stop_id", (F.col("end_t") - F.col("cost")).alias("t"))
    targets = cut(access(requests, tt.stops, "from_lat", "from_lon"))
    labels = search(end, tt.stop_times, transfers, rounds, back=True, bound=_pruning(targets), delta=delta, horizon=horizon)
    mirrored = pick_itineraries(labels.withColumn("t", -F.col("t")), targets, (1.0,), rounds, delta)
    picked = cut(mirrored.select("query_id", "round", "stop_id", (-F.col("t")).alias("t"), (-F.col("final_t")).alias("leave_t"), "rank"))
    return picked, unwind(picked, labels, rounds, back=True)


def plan(requests: DataFrame, tt: Timetable, transfers: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Both kinds of requests: those with a start_t as depart_at(), others as arrive_by(). (query_id, rank, start_t, final_t) of the itineraries
    (backward: the first leg's start and the last one's end) and the legs."""
    ahead, legs = depart_at(requests.where("start_t is not null"), tt, transfers, **options)
    behind, legs_back = arrive_by(requests.where("start_t is null and end_t is not null"), tt, transfers, **options)
    a = ahead.join(requests.select("query_id", "start_t"), "query_id").select("query_id", "rank", "start_t", "final_t")
    b = behind.select("query_id", "rank").join(legs_back.groupBy("query_id", "rank").agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("final_t")), ["query_id", "rank"])
    return a.unionByName(b), legs.unionByName(legs_back)
