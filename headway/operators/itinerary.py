"""Answers: clipped shapes, response rows and JSON, and how two itineraries are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.polyline import encode_polyline

#: Places this near in degrees are the same.
SAME_PLACE = 1e-8


def clip_by_distance(points: Column, start: Column, end: Column) -> Column:
    """The shape points (lat, lon, dist) from distance start up to, not including, end."""
    return F.filter(points, lambda p: (p["dist"] >= start) & (p["dist"] < end))


def closest_on_line(points: Column, lat: Column, lon: Column) -> Column:
    """struct(d2, k, f): the place on the polyline nearest to a point, in squared degrees: after point k by the fraction f of the segment. First of equal ones."""

    def of(p: Column, k: Column) -> Column:
        q = F.get(points, k + 1)
        dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]
        size = dx * dx + dy * dy
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((lon - p["lon"]) * dx + (lat - p["lat"]) * dy, size), F.lit(0.0))))
        ex, ey = p["lon"] + f * dx - lon, p["lat"] + f * dy - lat
        return F.struct((ex * ex + ey * ey).alias("d2"), k.alias("k"), f.alias("f"))

    return F.array_min(F.transform(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), of))


def ridden(points: Column, a: Column, b: Column, a_dist: Column, b_dist: Column) -> Column:
    """The part of a line's shape between two stops a and b (structs lat, lon): by distance where both are known and points lie between, else
    between the places on the shape that are nearest to them."""
    by_distance = clip_by_distance(points, a_dist, b_dist)
    first, last = closest_on_line(points, a["lat"], a["lon"])["k"], closest_on_line(points, b["lat"], b["lon"])["k"]
    by_place = F.slice(points, F.least(first, last) + 2, F.greatest(F.abs(last - first), F.lit(0)))
    return F.when(a_dist.isNotNull() & b_dist.isNotNull() & (F.size(by_distance) > 0), by_distance).otherwise(by_place)


def described(legs: DataFrame, stops: DataFrame, lines: DataFrame, line_stops: DataFrame, trips: DataFrame) -> DataFrame:
    """legs as unwind() gives them, with a and b (structs lat, lon, stop), and for rides transit_route, transit_agency, headsign and route_shape (an
    encoded polyline). lines: (line_id, route_name, agency_name, points), line_stops: (line_id, seq, dist), trips: (trip_id, line_id, headsign)."""
    place = lambda c, p: stops.select(F.col("stop_id").alias(c), F.struct("lat", "lon", F.col("stop_id").cast("string").alias("stop")).alias(p))
    out = legs.join(place("from_stop", "a"), "from_stop").join(place("to_stop", "b"), "to_stop").join(trips.select("trip_id", "line_id", "headsign"), "trip_id", "left").join(lines.select("line_id", "route_name", "agency_name", "points"), "line_id", "left")
    dist = lambda c, d: line_stops.select("line_id", F.col("seq").alias(c), F.col("dist").alias(d))
    out = out.join(dist("from_seq", "a_dist"), ["line_id", "from_seq"], "left").join(dist("to_seq", "b_dist"), ["line_id", "to_seq"], "left")
    shape = F.when((F.col("kind") == "transit") & (F.size("points") > 1), F.transform(ridden(F.col("points"), F.col("a"), F.col("b"), F.col("a_dist"), F.col("b_dist")), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))))
    return out.select("query_id", "rank", "pos", "kind", "trip_id", "start_t", "end_t", "a", "b", F.col("route_name").alias("transit_route"), F.col("agency_name").alias("transit_agency"), "headsign", encode_polyline()(shape).alias("route_shape"))


def _json(columns: dict[str, Column], left_out: str | None = None) -> Column:
    """A JSON object with explicit nulls; `left_out` names a key that isn't written when null."""
    text = lambda names: F.to_json(F.struct(*[columns[c].alias(c) for c in names]), {"ignoreNullFields": "false"})
    every = list(columns)
    return text(every) if left_out is None else F.when(columns[left_out].isNull(), text([c for c in every if c != left_out])).otherwise(text(every))


def responses(itineraries: DataFrame, legs: DataFrame, requests: DataFrame) -> DataFrame:
    """itineraries: (query_id, rank, start_t, final_t), legs: as described() gives them, requests: (query_id, from_lat, from_lon, to_lat, to_lon).
    (query_id, status, response): one JSON text for each request, with itineraries in order; times in epoch milliseconds, legs tagged transit or
    transfer. A shape that isn't known is left out, other unknown values are null. A request without itineraries has an empty list."""
    ms = lambda c: F.col(c) * 1000
    both = {"start_time": ms("start_t"), "end_time": ms("end_t"), "start_location": F.col("a"), "end_location": F.col("b")}
    ride = _json({**both, "route_shape": F.col("route_shape"), "transit_route": F.col("transit_route"), "transit_agency": F.col("transit_agency")}, "route_shape")
    walk = _json({**both, "route_shape": F.col("route_shape")})
    leg = F.when(F.col("kind") == "transit", F.concat(F.lit('{"transit":'), ride, F.lit("}"))).otherwise(F.concat(F.lit('{"transfer":'), walk, F.lit("}")))
    joined = legs.groupBy("query_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", leg.alias("leg")))), lambda x: x["leg"]), ",").alias("legs"))
    place = lambda e: F.struct(F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon"))
    head = _json({"start_location": place("from"), "end_location": place("to"), "start_time": ms("start_t"), "end_time": ms("final_t")})
    each = itineraries.join(requests.select("query_id", "from_lat", "from_lon", "to_lat", "to_lon"), "query_id").join(joined, ["query_id", "rank"])
    one = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"legs":['), F.col("legs"), F.lit("]}"))
    every = each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("i")))), lambda x: x["i"]), ",").alias("all"))
    full = requests.select("query_id").join(every, "query_id", "left")
    return full.select("query_id", F.lit("ok").alias("status"), F.concat(F.lit('{"status":"ok","itineraries":['), F.coalesce("all", F.lit("")), F.lit("]}")).alias("response"))


PLACE = "struct<lat:double,lon:double,stop:string>"
LEG = f"struct<start_time:bigint,end_time:bigint,start_location:{PLACE},end_location:{PLACE},route_shape:string,transit_route:string,transit_agency:string>"
RESPONSE = f"struct<status:string,itineraries:array<struct<start_location:{PLACE},end_location:{PLACE},start_time:bigint,end_time:bigint,legs:array<struct<transit:{LEG},transfer:{LEG}>>>>>"


def parse_responses(bodies: DataFrame, column: str = "response") -> DataFrame:
    """bodies with `column`, a response as JSON, parsed: struct<status, itineraries>."""
    return bodies.withColumn(column, F.from_json(column, RESPONSE))


def same_place(a: Column, b: Column) -> Column:
    """Whether two locations agree: coordinates to SAME_PLACE degrees, and the same stop or none."""
    return (F.abs(a["lat"] - b["lat"]) < SAME_PLACE) & (F.abs(a["lon"] - b["lon"]) < SAME_PLACE) & a["stop"].eqNullSafe(b["stop"])


def _same_legs(x: Column, y: Column) -> Column:
    rides = x["transit"].isNotNull()
    p, q = F.coalesce(x["transit"], x["transfer"]), F.coalesce(y["transit"], y["transfer"])
    starts, ends = same_place(p["start_location"], q["start_location"]), same_place(p["end_location"], q["end_location"])
    start_t, end_t = p["start_time"] == q["start_time"], p["end_time"] == q["end_time"]
    shape = ~(starts & ends) | p["route_shape"].eqNullSafe(q["route_shape"])
    # the same vehicle, whichever of two neighbouring stops it is boarded or left at
    ride = p["transit_route"].eqNullSafe(q["transit_route"]) & p["transit_agency"].eqNullSafe(q["transit_agency"]) & (~starts | start_t) & (~ends | end_t)
    return (rides == y["transit"].isNotNull()) & (starts | ends) & shape & F.when(rides, ride).otherwise(start_t | end_t)


def same_itinerary(x: Column, y: Column) -> Column:
    """Whether two itineraries (of RESPONSE's type) are equivalent: equal ends, times and number of legs, and legs that are the same vehicle or walk with at
    least one end in common."""
    legs = F.forall(F.arrays_zip(x["legs"].alias("p"), y["legs"].alias("q")), lambda z: F.coalesce(_same_legs(z["p"], z["q"]), F.lit(False)))
    return same_place(x["start_location"], y["start_location"]) & same_place(x["end_location"], y["end_location"]) & (x["start_time"] == y["start_time"]) & (x["end_time"] == y["end_time"]) & (F.size(x["legs"]) == F.size(y["legs"])) & legs


def same_response(x: Column, y: Column) -> Column:
    """Whether two responses have the same status and, in order, equivalent itineraries: what a golden case is compared by."""
    each = F.forall(F.arrays_zip(x["itineraries"].alias("p"), y["itineraries"].alias("q")), lambda z: F.coalesce(same_itinerary(z["p"], z["q"]), F.lit(False)))
    return (x["status"] == y["status"]) & (F.size(x["itineraries"]) == F.size(y["itineraries"])) & each
