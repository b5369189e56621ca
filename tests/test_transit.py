import datetime
import json
import zipfile
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headway import queries
from headway.functions.polyline import decode_points, encode_points
from headway.operators import itinerary, raptor, spatial, walking
from headway.plans import build, journeys
from headway.sources import gtfs, registry, timetable

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df, columns):
    return sorted("|".join(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_legs_join_up(spark):
    legs = queries.itinerary_legs(spark, SF).orderBy("query_id", "rank", "pos").collect()
    assert legs
    for a, b in zip(legs, legs[1:], strict=False):
        assert a["start_t"] <= a["end_t"]
        if (a["query_id"], a["rank"]) == (b["query_id"], b["rank"]):
            assert a["to_stop"] == b["from_stop"] and a["end_t"] <= b["start_t"] and not a["kind"] == b["kind"] == "transfer"
    for r in queries.plan_responses(spark, SF).collect():
        body = json.loads(r["response"])
        assert body["status"] == "ok" and all(set(x) in ({"transit"}, {"transfer"}) for i in body["itineraries"] for x in i["legs"])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@given(st.lists(st.tuples(st.integers(-9_000_000, 9_000_000), st.integers(-18_000_000, 18_000_000)), max_size=20))
def test_polyline_round_trip(points):
    at = [(a / 1e5, b / 1e5) for a, b in points]
    assert decode_points(encode_points(at)) == at


def test_known_polyline():
    assert encode_points([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_gtfs_feeds(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("agency.txt", "agency_id,agency_name,agency_timezone\na,One,UTC\n")
        z.writestr("stops.txt", "stop_id,stop_name,stop_lat,stop_lon\ns1,First,47.5,-122.4\ns2,,47.6,-122.4\n")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    (tmp_path / "note.txt").write_text("x")
    found = gtfs.read_feeds(spark, str(tmp_path))
    got = {(r["feed_id"], r["member"]): (r["n"], r["error"] is not None) for r in gtfs.counts(found).collect()}
    assert got == {("good", "agency"): (1, False), ("good", "stops"): (2, False), ("bad", None): (1, True)}
    assert [r["stop_name"] for r in gtfs.table(found, "stops").orderBy("stop_id").collect()] == ["First", None]


def test_registry_files(spark, tmp_path):
    for name, body in queries.REGISTRY:
        (tmp_path / f"{name}.json").write_text(body)
    assert {r["target"] for r in registry.static_urls(registry.parse(registry.read(spark, str(tmp_path)))).collect()} == {"one.0.zip", "three.0.zip", "eight.0.zip"}


def test_timetable_store(spark, tmp_path):
    tt = timetable.derived(spark, SF)
    timetable.write(tt, str(tmp_path))
    back = timetable.read(spark, str(tmp_path))
    assert back.stop_times.count() == tt.stop_times.count() and back.on(3).stop_times.count() == tt.on(3).stop_times.count()


FEED = {
    "agency": "agency_id,agency_name,agency_timezone\nA,Alpha,America/Los_Angeles\nB,Beta,America/Los_Angeles\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name\nr1,A,1,First\nr2,B,,Second\nr3,,3,Nobody's\n",
    "trips": "route_id,service_id,trip_id,shape_id,trip_headsign\nr1,wk,t1,s1,North\nr1,wk,t2,s1,North\nr2,wk,t3,,East\nr3,wk,t4,,Nowhere\nr1,no,t5,s1,Never\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\na,Ash,47.600,-122.300\nb,Birch,47.610,-122.300\nc,Cedar,47.620,-122.300\nd,Dogwood,47.621,-122.300\ne,Elm,47.621,-122.270\nz,Unused,,\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,shape_dist_traveled\n"
    + "".join(f"{t},{h}:00:00,{h}:00:30,a,1,0\n{t},,,b,2,10\n{t},{h}:20:00,{h}:20:00,c,5,20\n" for t, h in (("t1", "8"), ("t2", "9"), ("t5", "8")))
    + "t3,08:40:00,08:41:00,d,1,\nt3,24:50:00,24:51:00,e,2,\nt4,8:00:00,8:00:00,a,1,\nt4,8:05:00,8:05:00,e,2,\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20250601,20250630\n",
    "calendar_dates": "service_id,date,exception_type\nwk,20250604,2\nwk,20250607,1\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled\ns1,47.600,-122.300,1,0\ns1,47.605,-122.301,2,5\ns1,47.610,-122.300,3,10\ns1,47.615,-122.299,4,15\ns1,47.620,-122.300,5,20\n",
}


def write_feed(path, **changed):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in {**FEED, **changed}.items():
            z.writestr(f"{name}.txt", body)


def epoch(day, hour, minute, second=0):
    """Of a Los Angeles summer day."""
    return int(datetime.datetime(2025, 6, day, hour, minute, second, tzinfo=datetime.timezone(datetime.timedelta(hours=-7))).timestamp())


def test_from_a_zip_to_answers(spark, tmp_path):
    write_feed(tmp_path / "one.zip")
    rows = gtfs.store_feeds(gtfs.read_feeds(spark, str(tmp_path)))
    tt = gtfs.build(rows, "2025-06-03", 5)
    assert {r["name"] for r in tt.stops.collect()} == {"Ash", "Birch", "Cedar", "Dogwood", "Elm"}
    lines = {r["route_name"]: r for r in tt.lines.collect()}
    assert set(lines) == {"1", "Second"} and lines["1"]["agency_name"] == "Alpha" and len(lines["1"]["points"]) == 5 and lines["Second"]["points"] is None
    days = {(r["gtfs_trip_id"], str(r["day"])) for r in tt.trips.collect()}
    assert days == {(t, f"2025-06-0{d}") for t in ("t1", "t2", "t3") for d in (3, 5, 6, 7)}  # the 4th is taken out, the 7th put in
    first = next(r for r in tt.trips.collect() if (r["gtfs_trip_id"], str(r["day"])) == ("t1", "2025-06-03"))
    times = [(r["arr"], r["dep"]) for r in tt.stop_times.where(F.col("trip_id") == first["trip_id"]).orderBy("seq").collect()]
    assert times == [(epoch(3, 8, 0), epoch(3, 8, 0, 30)), (epoch(3, 8, 10, 15), epoch(3, 8, 10, 15)), (epoch(3, 8, 20), epoch(3, 8, 20))]
    timetable.write(tt, str(tmp_path / "stored"))
    tt = timetable.read(spark, str(tmp_path / "stored"))
    body = {"from": {"lat": 47.6001, "lon": -122.3}, "to": {"lat": 47.6211, "lon": -122.27}}
    asked = spark.createDataFrame([(1, json.dumps({**body, "start_at": epoch(3, 7, 50) * 1000 + 5})), (2, json.dumps({**body, "end_at": epoch(4, 2, 0) * 1000})), (3, json.dumps({**body, "start_at": epoch(20, 7, 50) * 1000, "max_transfers": 9}))], "query_id bigint, body string")
    requests = journeys.parse_requests(asked)
    assert [(r["start_t"], r["end_t"], r["transfer_mode"], r["max_transfers"]) for r in requests.orderBy("query_id").collect()] == [(epoch(3, 7, 50), None, "walking", 5), (None, epoch(4, 2, 0), "walking", 5), (epoch(20, 7, 50), None, "walking", 5)]
    assert journeys.parse_requests(asked.select("query_id", F.lit("{}").alias("body")), 77).first()["start_t"] == 77
    found, legs = journeys.plan(requests, tt, spatial.transfers(tt.stops))
    answers = itinerary.responses(found, itinerary.described(legs, tt.stops, tt.lines, tt.line_stops, tt.trips), requests)
    got = {r["query_id"]: json.loads(r["response"]) for r in answers.collect()}
    assert got[3] == {"status": "ok", "itineraries": []}
    for k in (1, 2):
        (trip,) = got[k]["itineraries"]
        ride, walk, second = trip["legs"]
        assert (ride["transit"]["transit_route"], ride["transit"]["transit_agency"]) == ("1", "Alpha") and (second["transit"]["transit_route"], second["transit"]["transit_agency"]) == ("Second", "Beta")
        assert ride["transit"]["start_time"] == epoch(3, 8, 0, 30) * 1000 and second["transit"]["end_time"] == epoch(4, 0, 50) * 1000
        assert decode_points(ride["transit"]["route_shape"]) == [(47.6, -122.3), (47.605, -122.301), (47.61, -122.3), (47.615, -122.299)] and "route_shape" not in second["transit"]
        assert walk["transfer"]["route_shape"] is None and walk["transfer"]["start_time"] == (epoch(3, 8, 20) if k == 1 else epoch(3, 8, 41) - 79) * 1000 and trip["start_location"] == {"lat": 47.6001, "lon": -122.3}
    assert got[1]["itineraries"][0]["start_time"] == epoch(3, 7, 50) * 1000
    # golden comparison: the same vehicle from a neighbouring stop is equal, another route isn't
    parsed = lambda b: itinerary.parse_responses(spark.createDataFrame([(json.dumps(b),)], "response string")).select(F.col("response"))
    same = lambda a, b: parsed(a).withColumnRenamed("response", "x").crossJoin(parsed(b).withColumnRenamed("response", "y")).select(itinerary.same_response(F.col("x"), F.col("y"))).first()[0]
    moved = json.loads(json.dumps(got[1]))
    leg = moved["itineraries"][0]["legs"][0]["transit"]
    leg["start_location"] = {"lat": 47.61, "lon": -122.3, "stop": "x"}
    leg["start_time"] += 1000
    other = json.loads(json.dumps(got[1]))
    other["itineraries"][0]["legs"][0]["transit"]["transit_route"] = "2"
    assert same(got[1], got[1]) and same(got[1], moved) and not same(got[1], other) and not same(got[1], got[3])


def test_broken_feeds_leave_nothing_behind(spark, tmp_path):
    write_feed(tmp_path / "good.zip")
    write_feed(tmp_path / "late.zip", shapes="shape_id\n" + "x" * 200_000 + "\n")  # a field beyond the limit, after other tables were read
    whole = (tmp_path / "good.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    damaged = bytearray(whole)
    damaged[60:70] = b"\xff" * 10
    (tmp_path / "damaged.zip").write_bytes(bytes(damaged))
    rows = gtfs.store_feeds(gtfs.read_feeds(spark, str(tmp_path)))
    got = gtfs.counts(rows).collect()
    assert {r["feed_id"] for r in got if r["member"] is None} == {"late", "cut", "damaged"} and {r["feed_id"] for r in got if r["member"]} == {"good"}
    write_feed(tmp_path / "good.zip", stops=FEED["stops"].replace("47.600", ""))
    rows = gtfs.store_feeds(gtfs.read_feeds(spark, str(tmp_path)))
    with pytest.raises(Exception, match="no coordinates of stop a"):
        gtfs.build(rows, "2025-06-03", 5)


def test_feeds_together_keep_their_keys(spark, tmp_path):
    for name in ("p", "q"):
        (tmp_path / name).mkdir()
        write_feed(tmp_path / name / f"{name}.zip")
    parts = [gtfs.build(gtfs.store_feeds(gtfs.read_feeds(spark, str(tmp_path / n))), "2025-06-03", 5) for n in ("p", "q")]
    both = timetable.concat_timetables(parts)
    for table, key in (("stops", "stop_id"), ("lines", "line_id"), ("trips", "trip_id")):
        ids = [r[key] for r in getattr(both, table).collect()]
        assert sorted(ids) == list(range(len(ids))) and len(ids) == 2 * getattr(parts[0], table).count()
    named = both.stop_times.join(both.trips.select("trip_id", "feed_id"), "trip_id").join(both.stops.select("stop_id", F.col("feed_id").alias("of")), "stop_id")
    assert named.count() == 2 * parts[0].stop_times.count() and named.where("feed_id <> of").count() == 0
    assert both.line_stops.join(both.lines, "line_id").count() == 2 * parts[0].line_stops.count()


def by_hand(times, transfers, start, rounds):
    """Earliest arrivals by textbook rounds: per round, stop to best time."""
    best, frontier, trips = {start[0]: start[1]}, {start[0]: start[1]}, defaultdict(list)
    for t in times:
        trips[t["trip_id"]].append((t["seq"], t["stop_id"], t["arr"], t["dep"]))
    for _ in range(rounds):
        found = {}
        for calls in trips.values():
            calls.sort()
            on = False
            for _, stop, arr, dep in calls:
                if on and arr < best.get(stop, 1 << 60):
                    found[stop] = min(arr, found.get(stop, 1 << 60))
                on = on or frontier.get(stop, 1 << 60) <= dep
        walked = dict(found)
        for stop, t in found.items():
            for to, secs in transfers.get(stop, ()):
                if t + secs < min(best.get(to, 1 << 60), walked.get(to, 1 << 60)):
                    walked[to] = t + secs
        frontier = walked
        best.update(walked)
    return best


def test_search_and_pruning_by_hand(spark):
    tt, tr = queries._day(spark, SF)
    transfers = defaultdict(list)
    for r in tr.collect():
        transfers[r["from_stop"]].append((r["to_stop"], r["secs"]))
    times = tt.stop_times.collect()
    starts = spark.createDataFrame([(k, k, 25_000 + 4_000 * k) for k in range(5)], "query_id bigint, stop_id bigint, t bigint")
    got = {(r["query_id"], r["stop_id"]): r["t"] for r in raptor.best_times(raptor.search(starts, tt.stop_times, tr, 4)).collect()}
    assert got == {(k, s): t for k in range(5) for s, t in by_hand(times, transfers, (k, 25_000 + 4_000 * k), 4).items()}
    targets = spark.createDataFrame([(k, (k + 3 + j) % 10, 40 * j) for k in range(5) for j in range(2)], "query_id bigint, stop_id bigint, cost bigint")
    free, pruned = (raptor.pick_itineraries(raptor.search(starts, tt.stop_times, tr, 4, **options), targets, (0.5, 1.0, 2.0), 4, 3).collect() for options in ({}, {"bound": targets.withColumn("cost", F.col("cost") * 2), "delta": 3}))
    assert free and sorted(map(tuple, free)) == sorted(map(tuple, pruned))
    short = raptor.search(starts, tt.stop_times, tr, 1, horizon=60).where("kind = 'transit'")
    assert short.where("other_t - t > 60").count() == 0 and short.count() < raptor.search(starts, tt.stop_times, tr, 1).where("kind = 'transit'").count()


def test_paths_with_shapes_and_transfers(spark):
    edges = spark.createDataFrame([(0, 1, 2, 70_000), (0, 2, 3, 70_000), (0, 1, 3, 200_000)], "tile bigint, src bigint, dst bigint, weight_mm bigint")
    paths = walking.shortest_paths(edges, spark.createDataFrame([(0, 1, 3), (0, 3, 1)], "tile bigint, source bigint, target bigint"))
    shape = lambda *p: [{"lat": float(x), "lon": 0.0} for x in p]
    shapes = spark.createDataFrame([(1, 2, shape(1, 1.5, 2)), (2, 3, shape(2, 3)), (1, 3, shape(1, 3))], "src bigint, dst bigint, points array<struct<lat:double,lon:double>>")
    (r,) = walking.path_shapes(paths, shapes).collect()
    assert r["dist"] == 140_000 and [p["lat"] for p in r["points"]] == [1.0, 1.5, 2.0, 3.0]
    matrix = spark.createDataFrame([(1, 2, 140_000), (2, 1, 1_399)], "from_place bigint, to_place bigint, mm bigint")
    met = walking.walked_transfers(matrix, spark.createDataFrame([(1, 2), (2, 1), (1, 9)], "from_stop bigint, to_stop bigint"))
    assert sorted(map(tuple, met.collect())) == [(1, 2, 100), (2, 1, 0)]
    ids = walking.compact_ids(edges)
    assert sorted(tuple(x) for x in walking.translate(edges.select("src", "dst"), ids, ["src", "dst"]).select("src", "dst").collect()) == [(0, 1), (0, 2), (1, 2)]
    length = lambda *p: spark.createDataFrame([(shape(*p),)], "s array<struct<lat:double,lon:double>>").select(walking.shape_length_mm(F.col("s"))).first()[0]
    assert length(0, 0.001) == 111_194 and length(5) == 0
    with pytest.raises(Exception, match="edge too long"):
        length(0, 40)


def test_builds_are_taken_up_again(spark, tmp_path):
    feeds, out = tmp_path / "in", f"file://{tmp_path}/out"
    feeds.mkdir()
    write_feed(feeds / "one.zip")
    with pytest.raises(FileNotFoundError):
        build.build(spark, str(feeds), out, "2025-06-03", 2, "concat")
    path = build.build(spark, str(feeds), out, "2025-06-03", 2, "prepare")
    assert build.complete(spark, f"{path}/feeds") and not build.complete(spark, f"{path}/lines")
    assert build.build(spark, str(feeds), out, "2025-06-03", 2, "concat") == path
    when = (tmp_path / "out" / path.rpartition("/")[2] / "stops" / "_SUCCESS").stat().st_mtime_ns
    assert build.build(spark, str(feeds), out, "2025-06-03", 2) == path and (tmp_path / "out" / path.rpartition("/")[2] / "stops" / "_SUCCESS").stat().st_mtime_ns == when
    tt, transfers = build.opened(spark, path)
    assert tt.stops.count() == 5 and transfers.count() == 2
    write_feed(feeds / "one.zip", agency=FEED["agency"].replace("Alpha", "Omega"))
    assert build.feeds_key(spark, str(feeds), "2025-06-03", 2) != path.rpartition("/")[2] != build.feeds_key(spark, str(feeds), "2025-06-03", 3)


def copied(tmp_path, **changed):
    """The smallest tables with some replaced by what SQL selects from them; their folder and a connection that has them."""
    con = duckdb.connect()
    for t in "region nation customer supplier orders".split():
        con.execute(f"copy ({changed.get(t, 'select * from t').replace('from t', f"from read_parquet('{SF}/{t}.parquet') t")}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    return str(tmp_path), con


def same_as_sql(spark, folder, con, name):
    df = queries.QUERIES[name](spark, folder)
    columns = ", ".join(df.columns)
    got, want = [tuple(r) for r in df.collect()], con.execute(f"select {columns} from ({queries.ORACLES[name]})").fetchall()
    assert want and sorted(map(str, got)) == sorted(map(str, want))
    return df


def test_lines_longer_than_street_edges_may_be(spark, tmp_path):
    got = same_as_sql(spark, *copied(tmp_path, supplier="select * replace (s_suppkey * 20000 as s_suppkey) from t"), "shape_lengths")
    assert got.agg(F.max("metres")).first()[0] > 4_294_967.295


def most_rows(df):
    """The most rows that an operator of df's plan gives, after df has run."""
    df.collect()
    seen = [0]

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            walk(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(p.plan())
        n = p.metrics().get("numOutputRows")
        if n.isDefined():
            seen.append(n.get().value())
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return max(seen)


MANY_STOPS = "select * replace (s_suppkey + i * 10 as s_suppkey) from t, range(500) r(i)"


@pytest.mark.parametrize("name", ["targets_reached", "plan_itineraries"])
def test_targets_that_no_ride_reaches_make_no_rows(spark, tmp_path, name):
    folder, con = copied(tmp_path, supplier=MANY_STOPS)
    assert most_rows(same_as_sql(spark, folder, con, name)) < 60_000  # 250 queries have 138,889 targets


#: Every start of a line and day is that of 4 trips, whose numbers and times are equal apart from a multiple of 7 * 1140.
MANY_TRIPS = "select * replace (o_orderkey + i * 7980 as o_orderkey) from t, range(4) r(i)"


@pytest.mark.parametrize("name", ["earliest_trip", "latest_trip", "board_one_per_route", "raptor_arrive_by"])
def test_trips_that_run_alike_are_stored_by_first_and_last(spark, tmp_path, name):
    folder, con = copied(tmp_path, orders=MANY_TRIPS)
    same_as_sql(spark, folder, con, name)
    tt, _ = queries._day(spark, folder)
    assert {r[0] for r in tt.trips.select("service_dow").distinct().collect()} == {queries.DOW}
    assert tt.stop_times.groupBy("line_id", "seq", "stop_id", "dep").count().agg(F.max("count")).first()[0] == 2
    assert tt.trips.count() == con.execute(f"select count(*) from orders where o_orderkey % 7 = {queries.DOW}").fetchall()[0][0]


@pytest.mark.parametrize("back", [False, True])
def test_a_label_meets_few_of_the_times_at_a_stop(spark, back):
    """Against all times, over slots, waits, places a line calls at twice and times before 0."""
    trips = [(i, i % 2, (i * 37 % 400 - 60) * 120) for i in range(800)]
    times = spark.createDataFrame([(trip, line, seq, seq % 2, start + 60 * seq, start + 60 * seq + 20) for trip, line, start in trips for seq in range(3)], "trip_id bigint, line_id bigint, seq int, stop_id bigint, arr bigint, dep bigint")
    frontier = spark.createDataFrame([(q, stop, t, "start") for q, t in enumerate((-9_000, -1, 0, 1_799, 1_800, 20_000, 40_000, 99_000)) for stop in (0, 1)], "query_id bigint, stop_id bigint, t bigint, kind string")
    con, at, pick = duckdb.connect(), *(("arr", "max") if back else ("dep", "min"))
    con.register("st", times.toPandas())
    con.register("f", frontier.toPandas())
    for horizon in (None, 100, 5_000):
        df = (raptor.latest_trips if back else raptor.earliest_trips)(frontier, times, horizon)
        wait = f"t - {at}" if back else f"{at} - t"
        want = con.execute(f"select query_id, line_id, seq, {pick}({{'at': {at}, 'trip': trip_id, 'stop': stop_id}}) as b from f join st using (stop_id) where {wait} between 0 and {1 << 60 if horizon is None else horizon} group by all").fetchall()
        got = [(r["query_id"], r["line_id"], r["alight_seq" if back else "board_seq"], {"at": r["alight_arr" if back else "board_dep"], "trip": r["trip_id"], "stop": r["alight_stop" if back else "board_stop"]}) for r in df.collect()]
        assert want and sorted(got, key=str) == sorted(want, key=str)
    every = con.execute(f"select count(*) from f join st using (stop_id) where {'t - arr' if back else 'dep - t'} >= 0").fetchall()[0][0]
    assert raptor._found(frontier, raptor.time_slots(times, back), back, None).count() * 10 < every
