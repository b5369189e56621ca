"""GTFS feeds: zip archives of CSV tables to DataFrames, with what can't be read kept aside, and to a timetable."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.constants import SERVICE_DAYS
from headway.functions.clock import clock_seconds, service_day_start
from headway.functions.geo import with_cartesian
from headway.plans.lineage import cut, shared_path
from headway.sources.timetable import Timetable, dense_ids

#: The columns that are read of each table.
TABLES = {
    "agency": ("agency_id", "agency_name", "agency_timezone"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name"),
    "trips": ("trip_id", "route_id", "service_id", "shape_id", "trip_headsign"),
    "stop_times": ("trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time", "shape_dist_traveled"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "shapes": ("shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled"),
}
WEEKDAYS = TABLES["calendar"][1:8]
#: All that reading a damaged, encrypted or oddly packed archive raises.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, UnicodeDecodeError, csv.Error, ValueError)


def read_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """(feed_id, member, row map, error) of all *.zip in a folder; a feed that can't be read to its end has a row with member null and its error.
    An archive is one row in memory, its tables are read 5,000 rows at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                feed = path.rpartition("/")[2].removesuffix(".zip")
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            table = name.rpartition("/")[2].removesuffix(".txt")
                            if table in TABLES:
                                with z.open(name) as f:
                                    reader = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig"))
                                    while rows := [{k.strip(): (v or "").strip() for k, v in r.items() if k} for _, r in zip(range(5000), reader)]:  # noqa: B905
                                        yield pd.DataFrame({"feed_id": feed, "member": table, "row": rows, "error": None})
                except BROKEN as e:
                    yield pd.DataFrame({"feed_id": [feed], "member": [None], "row": [None], "error": [f"{type(e).__name__}: {e}"]})

    return files.mapInPandas(members, "feed_id string, member string, row map<string,string>, error string")


def store_feeds(rows: DataFrame, path: str | None = None) -> DataFrame:
    """read_feeds() written once, by member, so that each table reads its own rows; feeds with an error keep only that. A run that was broken off is
    written anew as a whole (the folder has _SUCCESS when it is complete)."""
    path = path or shared_path(rows.sparkSession, "feeds")
    rows.write.mode("overwrite").partitionBy("member").parquet(path)
    return stored_feeds(rows.sparkSession, path)


def stored_feeds(spark: SparkSession, path: str) -> DataFrame:
    """What store_feeds() wrote."""
    stored = spark.read.schema("feed_id string, row map<string,string>, error string, member string").parquet(path)
    bad = stored.where("error is not null").select("feed_id").distinct()
    return stored.join(F.broadcast(bad), "feed_id", "left_anti").unionByName(stored.where("error is not null"))  # one row a feed


def table(rows: DataFrame, name: str) -> DataFrame:
    """A table of read_feeds() or store_feeds() with its columns as strings; empty values are null."""
    return rows.where(F.col("member") == name).select("feed_id", *[F.nullif(F.col("row")[c], F.lit("")).alias(c) for c in TABLES[name]])


def counts(rows: DataFrame) -> DataFrame:
    """Rows of each feed's tables, for checking feeds without building anything."""
    return rows.groupBy("feed_id", "member").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error"))


def _own(df: DataFrame, *names: str) -> list[str]:
    """Those columns, and the feed's where there is one."""
    return [c for c in ("feed_id", *names) if c in df.columns]


def service_days(calendar: DataFrame, exceptions: DataFrame, start: str, days: int = SERVICE_DAYS) -> DataFrame:
    """([feed_id,] service_id, day): weekdays of the calendar, with added and without removed dates, within start to start + days (both included)."""
    by = _own(calendar, "service_id")
    window = F.expr(f"explode(sequence(date'{start}', date_add(date'{start}', {days})))")
    weekday = F.element_at(F.array(*[F.col(d) for d in WEEKDAYS]), F.weekday("day") + 1)
    regular = calendar.withColumn("day", window).where((F.col("day") >= F.col("start_date")) & (F.col("day") <= F.col("end_date")) & (weekday == 1)).select(*by, "day")
    last = F.expr(f"date between date'{start}' and date_add(date'{start}', {days})")
    added = exceptions.where(last & (F.col("exception_type") == 1)).select(*by, F.col("date").alias("day"))
    removed = exceptions.where(F.col("exception_type") == 2).select(*by, F.col("date").alias("day"))
    return regular.unionByName(added).distinct().join(removed, [*by, "day"], "left_anti")


def agency_zones(trips: DataFrame, routes: DataFrame, agencies: DataFrame) -> DataFrame:
    """Trips (with feed_id) and their route's names, agency's name and zone. Routes without an agency are left out; one with an unknown agency takes
    the zone of the feed's only agency, or fails."""
    only = agencies.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"), F.max("agency_timezone").alias("only_zone"))
    known = trips.join(routes.where("agency_id is not null"), ["feed_id", "route_id"]).join(agencies, ["feed_id", "agency_id"], "left").join(only, "feed_id", "left")
    zone = F.coalesce("agency_timezone", F.when(F.col("n") == 1, F.col("only_zone")), F.raise_error(F.lit("no agency for the route")))
    return known.withColumn("zone", zone).drop("n", "only_zone", "agency_timezone")


def route_name(short: str = "route_short_name", long: str = "route_long_name"):
    return F.coalesce(F.nullif(F.col(short), F.lit("")), F.col(long))


def relative_times(stop_times: DataFrame, by: Sequence[str]) -> DataFrame:
    """stop_times with seq (places from 0), and a and d, seconds of the service day. A missing time takes the other one; where both are missing they are
    interpolated between stops that have them, by place. by: the columns that name a trip."""
    own = Window.partitionBy(*by).orderBy("stop_sequence")
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    st = stop_times.withColumn("seq", (F.row_number().over(own) - 1).cast("int"))
    st = st.withColumns({"a": clock_seconds(F.col("arrival_time")), "d": clock_seconds(F.col("departure_time"))})
    st = st.withColumns({"a": F.coalesce("a", "d"), "d": F.coalesce("d", "a")})
    st = st.withColumns({"s0": F.last(F.when(F.col("d").isNotNull(), F.col("seq")), True).over(back), "d0": F.last("d", True).over(back), "s1": F.first(F.when(F.col("a").isNotNull(), F.col("seq")), True).over(ahead), "a1": F.first("a", True).over(ahead)})
    between = F.floor(F.col("d0") + (F.col("a1") - F.col("d0")) * (F.col("seq") - F.col("s0")) / (F.col("s1") - F.col("s0"))).cast("bigint")
    t = lambda c: F.coalesce(F.col(c), F.when(F.col("s1") > F.col("s0"), between), F.col("d0"), F.col("a1"))
    return st.withColumns({"a": t("a"), "d": t("d")}).drop("s0", "d0", "s1", "a1")


def absolute_times(stop_times: DataFrame) -> DataFrame:
    """stop_times (trip_id, stop_sequence, stop_id, arrival_time, departure_time, day, zone) with seq, arr and dep in epoch seconds, missing times as
    relative_times() fills them."""
    start = service_day_start(F.col("day"), F.col("zone"))
    st = relative_times(stop_times, ["trip_id", "day"])
    return st.withColumns({"arr": start + F.col("a"), "dep": start + F.col("d")}).drop("a", "d")


def patterns(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """([feed_id,] trip_id, route_id, stop_ids): the ordered stops that, with the route, make a trip's pattern."""
    by = _own(stop_times, "trip_id")
    ordered = stop_times.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("s"))
    return ordered.select(*by, F.transform("s", lambda x: x["stop_id"]).alias("stop_ids")).join(trips.select(*by, "route_id"), by)


def pattern_ids(of_trips: DataFrame) -> DataFrame:
    """(pattern_id, [feed_id,] route_id, stop_ids, first_trip, n_trips), numbered by route and stops; first_trip gives the pattern's attributes."""
    by = _own(of_trips, "route_id", "stop_ids")
    return dense_ids(of_trips.groupBy(*by).agg(F.min("trip_id").alias("first_trip"), F.count(F.lit(1)).alias("n_trips")), by, "pattern_id")


def shapes(points: DataFrame) -> DataFrame:
    """([feed_id,] shape_id, points) in order."""
    p = F.struct("shape_pt_sequence", F.struct(F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon"), F.col("shape_dist_traveled").alias("dist")).alias("p"))
    return points.groupBy(*_own(points, "shape_id")).agg(F.transform(F.array_sort(F.collect_list(p)), lambda x: x["p"]).alias("points"))


def used_stops(stops: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The stops that some trip stops at; one of them without coordinates is an error."""
    used = stops.join(stop_times.select("feed_id", "stop_id").distinct(), ["feed_id", "stop_id"], "left_semi")
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("no coordinates of stop "), F.col("stop_id"))).cast("double"))
    return used.withColumns({"stop_lat": known("stop_lat"), "stop_lon": known("stop_lon")})


def _numbers(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})


def build(rows: DataFrame, start: str, days: int = SERVICE_DAYS) -> Timetable:
    """The timetable of all feeds of store_feeds() for the service days from `start` on: one trip for each GTFS trip and day. Ids are dense numbers in the order of feed and
    GTFS id; lines carry the route's and agency's names and the shape of their first trip, trips their head sign."""
    stops = _numbers(table(rows, "stops"), stop_lat="double", stop_lon="double")
    times = _numbers(table(rows, "stop_times"), stop_sequence="bigint", shape_dist_traveled="double").where("stop_sequence is not null")
    day = lambda c: F.to_date(F.col(c), "yyyyMMdd").alias(c)
    calendar = table(rows, "calendar").select("feed_id", "service_id", *[F.col(d).try_cast("int").alias(d) for d in WEEKDAYS], day("start_date"), day("end_date"))
    exceptions = table(rows, "calendar_dates").select("feed_id", "service_id", day("date"), F.col("exception_type").try_cast("int").alias("exception_type"))
    zoned = cut(agency_zones(table(rows, "trips"), table(rows, "routes"), table(rows, "agency")))
    of_trips = cut(patterns(times, zoned))
    lines = cut(pattern_ids(of_trips).withColumnRenamed("pattern_id", "line_id"))
    line_of = of_trips.join(lines.select("feed_id", "route_id", "stop_ids", "line_id"), ["feed_id", "route_id", "stop_ids"]).select("feed_id", "trip_id", "line_id")
    stop_ids = cut(dense_ids(used_stops(stops, times.join(of_trips.select("feed_id", "trip_id"), ["feed_id", "trip_id"], "left_semi")).withColumnRenamed("stop_id", "gtfs_stop_id"), ["feed_id", "gtfs_stop_id"], "stop_id"))
    out_stops = with_cartesian(stop_ids.select("stop_id", "feed_id", "gtfs_stop_id", F.col("stop_name").alias("name"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")))
    relative = cut(relative_times(times, ["feed_id", "trip_id"]).join(stop_ids.select("feed_id", F.col("gtfs_stop_id").alias("stop_id"), F.col("stop_id").alias("number")), ["feed_id", "stop_id"]).select("feed_id", "trip_id", "seq", F.col("number").alias("stop_id"), "a", "d", "shape_dist_traveled"))
    # a line's attributes are its first trip's
    first = lines.select("feed_id", F.col("first_trip").alias("trip_id"), "line_id")
    line_stops = first.join(relative, ["feed_id", "trip_id"]).select("line_id", "stop_id", "seq", F.col("shape_dist_traveled").alias("dist"))
    drawn = shapes(_numbers(table(rows, "shapes"), shape_pt_sequence="bigint", shape_pt_lat="double", shape_pt_lon="double", shape_dist_traveled="double"))
    named = first.join(zoned.select("feed_id", "trip_id", "shape_id", route_name().alias("route_name"), "agency_name"), ["feed_id", "trip_id"]).join(drawn, ["feed_id", "shape_id"], "left").select("line_id", "route_name", "agency_name", "points")
    runs = zoned.join(service_days(calendar, exceptions, start, days), ["feed_id", "service_id"]).join(line_of, ["feed_id", "trip_id"])
    runs = cut(dense_ids(runs.select("feed_id", F.col("trip_id").alias("gtfs_trip_id"), "line_id", "day", F.col("trip_headsign").alias("headsign"), service_day_start(F.col("day"), F.col("zone")).alias("zero")), ["feed_id", "gtfs_trip_id", "day"], "trip_id"))
    dow = F.weekday("day").cast("int").alias("service_dow")
    stop_times = runs.join(relative.withColumnRenamed("trip_id", "gtfs_trip_id"), ["feed_id", "gtfs_trip_id"]).select("trip_id", "line_id", dow, "seq", "stop_id", (F.col("zero") + F.col("a")).alias("arr"), (F.col("zero") + F.col("d")).alias("dep"))
    starts = stop_times.groupBy("trip_id").agg(F.min_by("dep", "seq").alias("start_s"))
    trips = runs.join(starts, "trip_id").select("trip_id", "line_id", dow, "headsign", "start_s", "feed_id", "gtfs_trip_id", "day")
    return Timetable(out_stops, line_stops, trips, stop_times, named)
