"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same wanted number of copies, target / source size. Its whole
part is given to all. The fractional parts are rounded in pairs: a random amount of words moves from one
document to the other until one of the two probabilities is 0 or 1; the other goes on to the next pair.
The moved amounts are words, so the words of a source are kept exactly at each step and the expectation
of each document stays what it was. Pairs meet inside small buckets (a fold over an array), the residual
of each bucket goes to the next level of a reduction tree, and one last document per source is rounded by
chance; so a source misses its target by less than one document.

DataFrame expressions only. A hot source has more buckets, not larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import materialize, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents, or residuals, that one fold takes.
FAN_IN = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the total of all sizes shared by weight, where no target exceeds
    `most` times its source's size and the excess goes to the others by weight.

    With the sources ordered by size / weight the capped ones come first, so one pass of running sums
    finds the level that repeated resharing ends at. sizes: (source, size); one row for each source
    passes through the single-partition windows, never documents."""
    by = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full", F.col("cap") / F.col("w"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("full", F.col("source").asc_nulls_last())
    before = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"total": F.sum("source_size").over(whole).cast("double"), "all_w": F.sum("w").over(whole)})
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    by = by.withColumn("share", F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(whole))
    return by.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("w"), F.col("cap"))).alias("target"))


def _chance(*what: Column) -> Column:
    """A fixed draw from [0, 1) for the values."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _fold(items: Column, seed: int) -> Column:
    """Folds an array of (id, s, p) into (carry, done): done has (id, up) of the settled ones."""
    item = "struct<id:bigint,s:double,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("carry"), F.expr("cast(array() as array<struct<id:bigint,up:boolean>>)").alias("done"))

    def merge(acc: Column, e: Column) -> Column:
        c = acc["carry"]
        down = F.least(c["p"] * c["s"], (1.0 - e["p"]) * e["s"])  # words that can go from c to e
        up = F.least((1.0 - c["p"]) * c["s"], e["p"] * e["s"])  # and from e to c

        def settle(x: Column) -> Column:
            to_e = _chance(F.lit(seed), c["id"], e["id"]) * (x["down"] + x["up"]) < x["up"]
            c_gone, e_full = c["p"] * c["s"] <= (1.0 - e["p"]) * e["s"], c["p"] * c["s"] >= (1.0 - e["p"]) * e["s"]
            c_full, e_gone = (1.0 - c["p"]) * c["s"] <= e["p"] * e["s"], (1.0 - c["p"]) * c["s"] >= e["p"] * e["s"]
            c_set, e_set = F.when(to_e, c_gone).otherwise(c_full), F.when(to_e, e_full).otherwise(e_gone)
            c_left = F.struct(c["id"].alias("id"), c["s"].alias("s"), F.when(to_e, c["p"] - x["down"] / c["s"]).otherwise(c["p"] + x["up"] / c["s"]).alias("p"))
            e_left = F.struct(e["id"].alias("id"), e["s"].alias("s"), F.when(to_e, e["p"] + x["down"] / e["s"]).otherwise(e["p"] - x["up"] / e["s"]).alias("p"))
            c_done, e_done = F.struct(c["id"].alias("id"), (~to_e).alias("up")), F.struct(e["id"].alias("id"), to_e.alias("up"))
            carry = F.when(c_set & e_set, F.lit(None).cast(item)).when(c_set, e_left).otherwise(c_left).cast(item)
            gone = F.when(c_set & e_set, F.array(c_done, e_done)).when(c_set, F.array(c_done)).otherwise(F.array(e_done))
            return F.struct(carry.alias("carry"), F.concat(acc["done"], gone).alias("done"))

        first = F.struct(e.cast(item).alias("carry"), acc["done"].alias("done"))
        return F.when(c.isNull(), first).otherwise(_let(F.struct(down.alias("down"), up.alias("up")), settle))

    return F.aggregate(items, start, merge)


def pivotal_round(units: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """units: (stratum, id bigint, s double > 0, p double in (0, 1)), ids unique in a stratum, with
    stratum_n = units of the stratum. Returns (stratum, id, up): up says that p was rounded up. The same
    units give the same answer."""
    most = units.agg(F.max("stratum_n")).first()[0]  # one number
    level = units.withColumn("b", F.pmod(F.xxhash64(F.lit(17), "id"), F.ceil(F.col("stratum_n") / F.lit(fan_in)).cast("bigint")))
    out, left, depth = [], most or 0, 0
    while True:
        grouped = level.groupBy("stratum", "b").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(depth), "id").alias("o"), "id", "s", "p"))).alias("items"))
        folded = grouped.select("stratum", "b", _fold(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["s"].alias("s"), x["p"].alias("p"))), depth).alias("f"))
        folded = materialize(folded, "mix")
        out.append(folded.select("stratum", F.inline("f.done")))
        carried = folded.where(F.col("f.carry").isNotNull()).select("stratum", "b", "f.carry.*")
        left, depth = -(-left // fan_in), depth + 1
        if left <= 1:
            out.append(carried.select("stratum", "id", (_chance(F.lit(99), F.col("id")) < F.col("p")).alias("up")))
            break
        level = carried.withColumn("b", F.floor(F.col("b") / F.lit(fan_in)).cast("bigint"))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row for each row of documents.

    size: words of the text, null counts as 0. Null sources are one source, the last. Rows that share id
    and source are one unit (null ids too): all of them get the same copies. Documents without words, and
    those of a source whose target is 0, take nothing; of long texts all words count. Ties of size / weight are broken by
    the source's name. Other columns are left out, whatever their names. An empty table gives an empty result.
    """
    rows = materialize(documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "sizes")
    targets = source_targets(rows)
    ranked = targets.withColumn("stratum", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("bigint"))
    ranked = materialize(ranked.withColumn("wish", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))), "targets")
    joined = rows.join(ranked, rows["source"].eqNullSafe(ranked["source"])).select(rows["id"], rows["source"], "size", "source_size", "target", "stratum", "wish", F.xxhash64(rows["id"].cast("string"), F.col("stratum")).alias("unit"))
    units = joined.where("size > 0 and wish > floor(wish)").groupBy("stratum", "unit").agg(F.sum("size").cast("double").alias("s"), F.max(F.col("wish") - F.floor("wish")).alias("p"))
    counts = units.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_n"))
    units = units.join(counts, "stratum").select("stratum", F.col("unit").alias("id"), "s", "p", "stratum_n")
    chosen = pivotal_round(materialize(units, "units")).where("up").select("stratum", F.col("id").alias("unit"), "up")
    out = joined.join(chosen, ["stratum", "unit"], "left")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.floor("wish").cast("bigint") + F.when(F.col("up"), F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each row as often as the mix takes it; columns as given, whatever their names.

    Rows that share id and source (repeated rows, null ids) are taken equally often. Null and blank texts are never
    taken; long ones count all their words. Null sources are one source. An empty table stays empty."""
    plan = mix(documents, id_col, text_col, source_col).groupBy("id", "source").agg(F.max("copies").cast("int").alias("n")).where("n > 0")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{source_col}`").cast("string").alias("own_source")).where(word_count(F.col(f"row.`{text_col}`")) > 0)
    taken = rows.join(plan, F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source"))).select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
