"""Connected components by alternating star operations on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import materialize


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links: (a bigint, b bigint). Returns (node, root) for each node of a link: root is the smallest node
    that can be reached.

    Each round points the larger neighbours of every node at its smallest one, then does the same to the
    smaller ones (large-star and small-star of Kiveris et al., 2014); the table never grows beyond the
    links and nodes. Rounds needed grow with the logarithm of the largest component. Each round's table
    is written to the shared folder, so a lost executor costs one round at most."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct().toDF("node", "root"))
