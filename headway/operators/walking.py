"""The pedestrian graph: directed edges, compact node ids, statistics and shortest walks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.constants import LAST_SECOND, OFF_ROAD_FACTOR, SNAP_RADIUS_M, WALK_MM_PER_S
from headway.functions.geo import great_circle, with_cartesian
from headway.operators.spatial import within
from headway.plans.lineage import cut
from headway.sources.timetable import dense_ids


def directed(edges: DataFrame) -> DataFrame:
    """edges (a, b, weight_mm, fwd, rev, use, is_transit, is_shortcut) as (src, dst, weight_mm): walkable directions, without self loops,
    transit lines, shortcuts and ferries."""
    ok = edges.where("not is_transit and not is_shortcut and use <> 'ferry' and a <> b")
    ways = F.filter(F.array(F.struct(F.col("fwd").alias("on"), F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("rev").alias("on"), F.col("b").alias("src"), F.col("a").alias("dst"))), lambda w: w["on"])
    return ok.select(F.explode(ways).alias("w"), "weight_mm").select("w.src", "w.dst", "weight_mm")


def shortest_parallel(edges: DataFrame) -> DataFrame:
    """(src, dst, length, ord): of parallel edges the shortest, of equal ones the first."""
    return edges.groupBy("src", "dst").agg(F.min(F.struct("length", "ord")).alias("e")).select("src", "dst", "e.*")


def compact_ids(edges: DataFrame) -> DataFrame:
    """(node, id): nodes of the edges numbered from 0 in order."""
    return dense_ids(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), ["node"], "id")


def translate(rows: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with node numbers instead of nodes in the columns; rows with a node that ids (node, id) doesn't have are left out."""
    for c in columns:
        rows = rows.join(ids.select(F.col("node").alias(c), F.col("id").alias("id_")), c).drop(c).withColumnRenamed("id_", c)
    return rows


def accessible(edges: DataFrame, nodes: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """The edges (a, b, ..., [end_tile]) that leave nodes (node, pedestrian) which pedestrians may use and end in a tile there is."""
    ok = edges.join(nodes.where("pedestrian").select(F.col("node").alias("a")), "a", "left_semi")
    return ok if tiles is None else ok.join(tiles.select(F.col("tile").alias("end_tile")), "end_tile", "left_semi")


def shape_length(shape: Column) -> Column:
    """Metres along a shape (array of structs lat, lon) on the sphere, however long."""
    step = lambda p, k: great_circle(F.get(shape, k)["lat"], F.get(shape, k)["lon"], p["lat"], p["lon"])
    steps = F.transform(F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0))), step)
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def shape_length_mm(shape: Column) -> Column:
    """Whole millimetres along a street edge's shape; an error where that exceeds 32 bits."""
    mm = F.floor(F.round(shape_length(shape) * 1000, 3)).cast("bigint")
    return F.when(mm > LAST_SECOND, F.raise_error(F.lit("edge too long")).cast("bigint")).otherwise(mm)


def geometry_points(edges: DataFrame) -> DataFrame:
    """(node, lat, lon): every shape point of the edges (a, shape), filed under the node that the edge leaves."""
    return edges.select(F.col("a").alias("node"), F.explode("shape").alias("p")).select("node", "p.lat", "p.lon")


def tile_manifest(tiles: DataFrame) -> DataFrame:
    """(tile, n_nodes) with first, the nodes of the tiles before it. One row a tile, so one task may hold them."""
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("first", F.coalesce(F.sum("n_nodes").over(before), F.lit(0)).cast("bigint"))


def class_ratios(classes: DataFrame) -> DataFrame:
    """From (class, n): all nodes, those that a contracted graph keeps (branches and dead ends) and those it collapses (chains), and their shares;
    0 where there are none."""
    kept, chains = F.sum(F.when(F.col("class").isin("branch", "dead_end"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("class") == "chain", F.col("n")).otherwise(0))
    share = lambda part: F.round(F.coalesce(F.try_divide(part.cast("double"), F.sum("n")), F.lit(0.0)), 6)
    return classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(kept, F.lit(0)).alias("kept"), F.coalesce(chains, F.lit(0)).alias("collapsed"), share(kept).alias("keep_ratio"), share(chains).alias("collapse_ratio"))


def snap(places: DataFrame, points: DataFrame, radius: float = SNAP_RADIUS_M) -> DataFrame:
    """places (place_id, lat, lon), points (node, lat, lon). (place_id, node, snap_mm): the graph nodes within the radius of a place, by their nearest point,
    and what going there off the road costs."""
    met = within(with_cartesian(places), with_cartesian(points), radius)
    mm = F.floor(F.col("d") * F.lit(1000.0) * F.lit(OFF_ROAD_FACTOR)).cast("bigint")
    return met.groupBy(F.col("a.place_id").alias("place_id"), F.col("b.node").alias("node")).agg(F.min(mm).alias("snap_mm"))


def walk_matrix(edges: DataFrame, places: DataFrame, points: DataFrame, limit_mm: int, radius: float = SNAP_RADIUS_M) -> DataFrame:
    """(from_place, to_place, mm): the shortest walk between different places over the graph, the way from and to the road included, if it is at most limit_mm."""
    snapped = cut(snap(places, points, radius))
    reached = shortest_from(edges, snapped.select(F.col("place_id").alias("source"), "node", F.col("snap_mm").alias("dist")), limit_mm)
    ends = snapped.select(F.col("place_id").alias("to_place"), "node", "snap_mm")
    met = reached.join(ends, "node").where("source <> to_place").withColumn("mm", F.col("dist") + F.col("snap_mm")).where(F.col("mm") <= limit_mm)
    return met.groupBy(F.col("source").alias("from_place"), "to_place").agg(F.min("mm").alias("mm"))


def walked_transfers(matrix: DataFrame, candidates: DataFrame) -> DataFrame:
    """(from_stop, to_stop, secs) of the stop pairs in straight-line reach that have a way over the streets."""
    pairs = candidates.select("from_stop", "to_stop")
    return pairs.join(matrix.select(F.col("from_place").alias("from_stop"), F.col("to_place").alias("to_stop"), "mm"), ["from_stop", "to_stop"]).select("from_stop", "to_stop", F.expr(f"mm div {WALK_MM_PER_S}").alias("secs"))


def path_shapes(paths: DataFrame, shapes: DataFrame) -> DataFrame:
    """paths (tile, source, target, dist, path), shapes (src, dst, points). (tile, source, target, dist, points): the shapes of the path's edges one after the other, points that
    repeat at a node once."""
    steps = paths.select("tile", "source", "target", "dist", F.posexplode(F.transform(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda b, k: F.struct(F.get(F.col("path"), k).alias("src"), b.alias("dst")))).alias("k", "e"))
    drawn = steps.join(shapes, (F.col("e.src") == F.col("src")) & (F.col("e.dst") == F.col("dst")))
    whole = drawn.groupBy("tile", "source", "target", "dist").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "points"))), lambda x: x["points"])).alias("p"))
    return whole.select("tile", "source", "target", "dist", F.filter("p", lambda x, k: (k == 0) | ~x.eqNullSafe(F.get(F.col("p"), k - 1))).alias("points"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, loops, neighbours)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_distinct("dst").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.count_distinct("src").alias("i"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.join(into, "node", "full").select("node", z("n_in").alias("n_in"), z("n_out").alias("n_out"), z("loops").alias("loops"), (z("o") + z("i")).alias("neighbours"))


def node_class():
    """A node's kind, by the first case that fits."""
    n = F.col("neighbours")
    return F.when(F.col("n_in") + F.col("n_out") == 0, "isolated").when((F.col("n_in") == 0) | (F.col("n_out") == 0), "dead_end").when(F.col("loops") > 0, "branch").when(n == 2, "chain").when(n > 2, "branch").otherwise("dead_end")


def shortest(edges: DataFrame, sources: DataFrame, limit_mm: int, rounds: int = 1000) -> DataFrame:
    """(source, node, dist): walks of at most limit_mm from each source node."""
    return shortest_from(edges, sources.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("dist")), limit_mm, rounds)


def shortest_from(edges: DataFrame, starts: DataFrame, limit_mm: int, rounds: int = 1000) -> DataFrame:
    """starts: (source, node, dist), any number of nodes a source begins at with what it costs to get there. (source, node, dist): walks of at most limit_mm, by
    relaxing the frontier until nothing improves. The limit bounds the rounds and the rows."""
    best = cut(starts.where(F.col("dist") <= limit_mm).groupBy("source", "node").agg(F.min("dist").alias("dist")))
    frontier = best
    for _ in range(rounds):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight_mm")).alias("dist")).where(F.col("dist") <= limit_mm)
        step = step.groupBy("source", "node").agg(F.min("dist").alias("dist"))
        frontier = cut(step.join(best.withColumnRenamed("dist", "known"), ["source", "node"], "left").where("known is null or dist < known").drop("known"))
        if frontier.isEmpty():
            return best
        best = cut(best.join(frontier, ["source", "node"], "left_anti").unionByName(frontier))
    raise RuntimeError("walks did not settle")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (tile, source, target), edges (tile, src, dst, weight_mm): (tile, source, target, dist, path array) by Dijkstra's
    algorithm inside each tile, whose edges must hold a margin as wide as walks may be long. Pairs without a way are left out."""
    import heapq

    def solve(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, int]]] = {}
        for a, b, w in zip(graph["src"], graph["dst"], graph["weight_mm"], strict=True):
            near.setdefault(int(a), []).append((int(b), int(w)))
        rows = []
        for source, targets in asked.groupby("source")["target"]:
            left, dist, prev, heap = set(map(int, targets)), {int(source): 0}, {}, [(0, int(source))]
            while heap and left:
                d, n = heapq.heappop(heap)
                if d > dist[n]:
                    continue
                if n in left:
                    left.discard(n)
                    path = [n]
                    while path[-1] in prev:
                        path.append(prev[path[-1]])
                    rows.append((key[0], int(source), n, d, path[::-1]))
                for m, w in near.get(n, ()):
                    if d + w < dist.get(m, 1 << 62):
                        dist[m], prev[m] = d + w, n
                        heapq.heappush(heap, (d + w, m))
        return pd.DataFrame(rows, columns=["tile", "source", "target", "dist", "path"])

    return edges.groupBy("tile").cogroup(pairs.groupBy("tile")).applyInPandas(solve, "tile bigint, source bigint, target bigint, dist bigint, path array<bigint>")
