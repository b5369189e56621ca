"""Round-based earliest arrival and latest departure for batches of queries.

State is the best time of each (query, stop) and the frontier, what the last round improved. A round boards
at frontier stops (the earliest trip of each line and place that leaves in time), rides downstream, keeps
the best arrival of each stop, then walks once. Only improvements go on, so joins shrink with each round.
Timetable rows are found by equi-join on stop and trip; of the times at a place those of the label's slot of time and one of each later slot.

A label is named by query, round, kind and stop, and holds the name of the label it came from, so a row is a few
numbers however long the journey; unwind() follows the names back for the labels that are picked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.plans.lineage import cut

#: What a label is reached by: the trip and its places at the stop and at the other end of the ride, the other end's stop and time, and the
#: kind of the label there.
CAME = ("trip_id", "seq", "other_seq", "other", "other_t", "other_kind")
LABEL = ("query_id", "stop_id", "t", "kind", *CAME)
#: Seconds of a slot of time; any length gives the same boardings.
SLOT_S = 1800


def _in_reach(wait, horizon: int | None):
    return F.lit(True) if horizon is None else wait <= horizon


def time_slots(stop_times: DataFrame, back: bool = False) -> tuple[DataFrame, DataFrame]:
    """What boardings (backward: alightings) look through: (stop_id, line_id, seq, slot, dep or arr, trip_id) of every time at a place, of equal ones the trip that
    ties go to; and of each slot of time the one that a label from another slot takes. So a label meets the times of its own slot and one of each other slot,
    however many trips there are."""
    at, first = ("arr", F.max) if back else ("dep", F.min)
    every = stop_times.groupBy("stop_id", "line_id", "seq", at).agg(first("trip_id").alias("trip_id")).withColumn("slot", _slot(at))
    edge = every.groupBy("stop_id", "line_id", "seq", "slot").agg(first(F.struct(at, "trip_id")).alias("e"))
    return every, edge.select("stop_id", "line_id", "seq", "slot", "e.*")


def _slot(t: str):
    return F.floor(F.col(t) / SLOT_S)


def _found(frontier: DataFrame, slots: tuple[DataFrame, DataFrame], back: bool, horizon: int | None) -> DataFrame:
    """The times that a frontier can take and that may be the best of their place."""
    every, edge = slots
    near = frontier.select("query_id", "stop_id", "t", "kind", _slot("t").alias("slot"))
    in_time = F.col("arr") <= F.col("t") if back else F.col("dep") >= F.col("t")
    same = near.join(every, ["stop_id", "slot"]).where(in_time)
    beyond = near.withColumnRenamed("slot", "own").join(edge, "stop_id").where(F.col("slot") < F.col("own") if back else F.col("slot") > F.col("own")).drop("own")
    wait = F.col("t") - F.col("arr") if back else F.col("dep") - F.col("t")
    return same.unionByName(beyond).where(_in_reach(wait, horizon))


def earliest_trips(frontier: DataFrame, stop_times: DataFrame, horizon: int | None = None, slots: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """frontier: (query_id, stop_id, t, kind). For each (query, line, place): the earliest trip that leaves a frontier stop at its time
    or later, ties by trip. horizon: the most seconds to wait, unbounded by default. slots: time_slots() of the stop_times, if they are there."""
    found = _found(frontier, slots or time_slots(stop_times), False, horizon)
    best = F.min(F.struct("dep", "trip_id", "stop_id", "kind"))
    return found.groupBy("query_id", "line_id", "seq").agg(best.alias("b")).select("query_id", "line_id", F.col("seq").alias("board_seq"), "b.trip_id", F.col("b.stop_id").alias("board_stop"), F.col("b.dep").alias("board_dep"), F.col("b.kind").alias("board_kind"))


def latest_trips(frontier: DataFrame, stop_times: DataFrame, horizon: int | None = None, slots: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The mirror image: the latest trip that arrives at a frontier stop in time, ties by the larger trip."""
    found = _found(frontier, slots or time_slots(stop_times, back=True), True, horizon)
    best = F.max(F.struct("arr", "trip_id", "stop_id", "kind"))
    return found.groupBy("query_id", "line_id", "seq").agg(best.alias("b")).select("query_id", "line_id", F.col("seq").alias("alight_seq"), "b.trip_id", F.col("b.stop_id").alias("alight_stop"), F.col("b.arr").alias("alight_arr"), F.col("b.kind").alias("alight_kind"))


def one_boarding(boardings: DataFrame) -> DataFrame:
    """One boarding for each query and line: the earliest departure, of equal ones the later place."""
    order = Window.partitionBy("query_id", "line_id").orderBy("board_dep", F.desc("board_seq"))
    return boardings.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def ride(boardings: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The best arrival at each stop after the boardings, as labels; of equal ones the later departure, then trip and place."""
    down = boardings.join(stop_times.select("trip_id", "seq", "stop_id", "arr"), "trip_id").where("seq > board_seq")
    best = F.min(F.struct("arr", (-F.col("board_dep")).alias("later"), "trip_id", "board_seq", "seq", "board_stop", "board_kind"))
    b = down.groupBy("query_id", "stop_id").agg(best.alias("b")).select("query_id", "stop_id", "b.*")
    return b.select("query_id", "stop_id", F.col("arr").alias("t"), F.lit("transit").alias("kind"), "trip_id", "seq", F.col("board_seq").alias("other_seq"), F.col("board_stop").alias("other"), (-F.col("later")).alias("other_t"), F.col("board_kind").alias("other_kind"))


def ride_back(alightings: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The latest departure at each stop before the alightings; of equal ones the earlier arrival, then trip and place."""
    up = alightings.join(stop_times.select("trip_id", "seq", "stop_id", "dep"), "trip_id").where("seq < alight_seq")
    best = F.min(F.struct((-F.col("dep")).alias("sooner"), "alight_arr", "trip_id", "alight_seq", "seq", "alight_stop", "alight_kind"))
    b = up.groupBy("query_id", "stop_id").agg(best.alias("b")).select("query_id", "stop_id", "b.*")
    return b.select("query_id", "stop_id", (-F.col("sooner")).alias("t"), F.lit("transit").alias("kind"), "trip_id", "seq", F.col("alight_seq").alias("other_seq"), F.col("alight_stop").alias("other"), F.col("alight_arr").alias("other_t"), F.col("alight_kind").alias("other_kind"))


def walk(labels: DataFrame, transfers: DataFrame, back: bool = False) -> DataFrame:
    """One walk from (or, backward, to) each label, as labels."""
    near, far = ("to_stop", "from_stop") if back else ("from_stop", "to_stop")
    moved = labels.select("query_id", F.col("stop_id").alias("other"), F.col("t").alias("other_t"), F.col("kind").alias("other_kind")).join(transfers.select(F.col(near).alias("other"), F.col(far).alias("stop_id"), "secs"), "other")
    t = F.col("other_t") - F.col("secs") if back else F.col("other_t") + F.col("secs")
    return moved.select("query_id", "stop_id", t.alias("t"), F.lit("transfer").alias("kind"), F.lit(None).cast("bigint").alias("trip_id"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("int").alias("other_seq"), "other", "other_t", "other_kind")


def search(start: DataFrame, stop_times: DataFrame, transfers: DataFrame, rounds: int, back: bool = False, one_per_line: bool = False, bound: DataFrame | None = None, delta: int | None = None, horizon: int | None = None) -> DataFrame:
    """start: (query_id, stop_id, t). All labels (query_id, round, stop_id, t, kind, *CAME): round 0 is the start; each later
    round has what it improved, transit labels also where a walk then beat them.

    back: times run down from a deadline. one_per_line: a line is boarded at one stop a round (see one_boarding), else wherever it helps.
    bound: (query_id, stop_id, cost) of targets: labels no better than the best transit arrival at a target, cost included, go no
    further, and with `delta` a query ends that many rounds after it first reaches a target. horizon: the most seconds to wait for a trip,
    unbounded by default."""
    sign = -1 if back else 1
    better = (lambda a, b: a > b) if back else (lambda a, b: a < b)

    def best_of(df: DataFrame) -> DataFrame:
        first = F.struct((sign * F.col("t")).alias("key"), (F.col("kind") == "transfer").alias("walked"), "other")
        return df.groupBy("query_id", "stop_id").agg(F.min_by(F.struct("t", "kind", *CAME), first).alias("b")).select("query_id", "stop_id", "b.*")

    nothing = {"trip_id": "bigint", "seq": "int", "other_seq": "int", "other": "bigint", "other_t": "bigint", "other_kind": "string"}
    begin = start.select("query_id", "stop_id", "t", F.lit("start").alias("kind"), *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])
    every, edge = time_slots(stop_times, back)
    slots = (cut(every), cut(edge))
    frontiers = [cut(best_of(begin))]
    labels, reached = [frontiers[0].withColumn("round", F.lit(0))], []
    for r in range(1, rounds + 1):
        frontier = frontiers[-1]
        if reached and delta is not None:
            ended = reduce(DataFrame.unionByName, reached).groupBy("query_id").agg(F.min("round").alias("first")).where(F.col("first") + delta <= r)
            frontier = frontier.join(ended, "query_id", "left_anti")
        if back:
            moved = ride_back(latest_trips(frontier, stop_times, horizon, slots), stop_times)
        else:
            boardings = earliest_trips(frontier, stop_times, horizon, slots)
            moved = ride(one_boarding(boardings) if one_per_line else boardings, stop_times)
        known = reduce(DataFrame.unionByName, [f.select("query_id", "stop_id", "t") for f in frontiers]).groupBy("query_id", "stop_id").agg((F.max if back else F.min)("t").alias("known"))
        improves = F.col("known").isNull() | better(F.col("t"), F.col("known"))
        transit = moved.join(known, ["query_id", "stop_id"], "left").where(improves).drop("known")
        if reached:
            most = reduce(DataFrame.unionByName, reached).groupBy("query_id").agg((F.max if back else F.min)("at").alias("most"))
            transit = transit.join(most, "query_id", "left").where(F.col("most").isNull() | better(F.col("t"), F.col("most"))).drop("most")
        transit = cut(transit.select(*LABEL))
        if bound is not None:
            reached.append(transit.select("query_id", "stop_id", "t").join(bound, ["query_id", "stop_id"]).groupBy("query_id").agg((F.max if back else F.min)(F.col("t") + sign * F.col("cost")).alias("at")).withColumn("round", F.lit(r)))
        new = best_of(transit.unionByName(walk(transit, transfers, back).select(*LABEL)))
        frontiers.append(cut(new.join(known, ["query_id", "stop_id"], "left").where(improves).select(*LABEL)))
        labels += [transit.withColumn("round", F.lit(r)), frontiers[-1].where("kind = 'transfer'").withColumn("round", F.lit(r))]
        if frontiers[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, labels).select("query_id", "round", "stop_id", "t", "kind", *CAME)


def unwind(picked: DataFrame, labels: DataFrame, rounds: int, back: bool = False) -> DataFrame:
    """picked: (query_id, rank, round, stop_id) of transit labels. The legs of their journeys (query_id, rank, pos, kind, trip_id, from_stop, to_stop,
    start_t, end_t, from_seq, to_seq), pos counting from 0 in the order of travel."""
    at = cut(picked.select("query_id", "rank", "round", F.lit("transit").alias("kind"), "stop_id"))
    legs = []
    for step in range(2 * rounds):
        found = cut(at.join(labels, ["query_id", "round", "kind", "stop_id"]).where("kind <> 'start'"))
        if found.isEmpty():
            break
        near = [F.col(c) for c in ("stop_id", "t", "seq")]
        far = [F.col(c) for c in ("other", "other_t", "other_seq")]
        (a, start, a_seq), (b, end, b_seq) = (near, far) if back else (far, near)
        legs.append(found.select("query_id", "rank", F.lit(step).alias("step"), "kind", "trip_id", a.alias("from_stop"), b.alias("to_stop"), start.alias("start_t"), end.alias("end_t"), a_seq.alias("from_seq"), b_seq.alias("to_seq")))
        at = found.select("query_id", "rank", F.when(F.col("kind") == "transit", F.col("round") - 1).otherwise(F.col("round")).alias("round"), F.col("other_kind").alias("kind"), F.col("other").alias("stop_id"))
    if not legs:
        return at.select("query_id", "rank", F.lit(0).alias("pos"), "kind", F.lit(None).cast("bigint").alias("trip_id"), *[F.lit(None).cast("bigint").alias(c) for c in ("from_stop", "to_stop", "start_t", "end_t")], F.lit(None).cast("int").alias("from_seq"), F.lit(None).cast("int").alias("to_seq")).where("false")
    order = Window.partitionBy("query_id", "rank").orderBy(F.col("step") if back else F.desc("step"))
    return reduce(DataFrame.unionByName, legs).withColumn("pos", F.row_number().over(order) - 1).select("query_id", "rank", "pos", "kind", "trip_id", "from_stop", "to_stop", "start_t", "end_t", "from_seq", "to_seq")


def best_times(labels: DataFrame, back: bool = False) -> DataFrame:
    """(query_id, stop_id, t, round): the best time of each stop and the first round that has it."""
    order = F.struct((-F.col("t") if back else F.col("t")).alias("t"), "round")
    return labels.groupBy("query_id", "stop_id").agg(F.min_by(F.struct("t", "round"), order).alias("b")).select("query_id", "stop_id", "b.*")


def running_best(labels: DataFrame) -> DataFrame:
    """(query_id, stop_id, round, t): an improvement of a round also holds in later ones."""
    per = labels.groupBy("query_id", "stop_id", "round").agg(F.min("t").alias("t"))
    over = Window.partitionBy("query_id", "stop_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("t", F.min("t").over(over))


def counters(labels: DataFrame) -> DataFrame:
    """What each round of a search did: (query_id, round, improved stops, rides, walks, earliest and latest time)."""
    return labels.groupBy("query_id", "round").agg(F.count_distinct("stop_id").alias("improved"), F.count_if(F.col("kind") == "transit").alias("rides"), F.count_if(F.col("kind") == "transfer").alias("walks"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def reach(labels: DataFrame, targets: DataFrame, asked: DataFrame) -> DataFrame:
    """targets: (query_id, stop_id), those that no ride reaches may be left out; asked: (query_id, targets), how many a query has with those. (query_id, targets,
    reached, rounds): how many of a query's targets transit reaches, and the last round that improved one; null if none."""
    at = labels.where("kind = 'transit'").groupBy("query_id", "stop_id").agg(F.max("round").alias("round")).join(targets.select("query_id", "stop_id").distinct(), ["query_id", "stop_id"])
    per = at.groupBy("query_id").agg(F.count("round").alias("reached"), F.max("round").alias("rounds"))
    return asked.join(per, "query_id", "left").select("query_id", "targets", F.coalesce("reached", F.lit(0)).cast("bigint").alias("reached"), "rounds")


def pick_itineraries(labels: DataFrame, targets: DataFrame, scalars: tuple[float, ...], max_rounds: int, delta: int) -> DataFrame:
    """targets: (query_id, stop_id, cost). For each walking scalar and round the label at a target, reached by transit, with the smallest arrival
    plus scaled cost; kept if it arrives before those of all earlier rounds; rounds up to the first that reaches a target plus delta. (query_id, round, stop_id, t, final_t),
    each once, in rank by arrival and round."""
    at = labels.where("kind = 'transit'").select("query_id", "round", "stop_id", "t").join(targets, ["query_id", "stop_id"])
    first = at.groupBy("query_id").agg(F.min("round").alias("first"))
    at = at.join(first, "query_id").where((F.col("round") < F.col("first") + delta) & (F.col("round") <= max_rounds))
    at = at.withColumn("scalar", F.explode(F.array(*map(F.lit, scalars)))).withColumn("score", F.col("t") + F.floor(F.col("cost") * F.col("scalar")))
    best = at.groupBy("query_id", "scalar", "round").agg(F.min(F.struct("score", "stop_id", "t", "cost")).alias("b")).select("query_id", "scalar", "round", "b.stop_id", "b.t", "b.cost")
    before = Window.partitionBy("query_id", "scalar").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("prev", F.min("t").over(before)).where("prev is null or t < prev")
    once = kept.withColumn("final_t", F.col("t") + F.col("cost")).dropDuplicates(["query_id", "round", "stop_id", "t"]).select("query_id", "round", "stop_id", "t", "final_t")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("t", "round", "stop_id")))
