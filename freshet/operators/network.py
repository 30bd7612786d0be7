"""Routing trees: tables of (id, next), next null at an outlet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upstream(tree: DataFrame, seed: DataFrame) -> DataFrame:
    """(id, depth) of all units that drain to the seed ids, depth counted to the first seed below; cycles without a seed are absent.

    Every way down is followed by doubling pointers until it meets a seed, so a river of n units takes
    log2(n) rounds.
    """
    ids = seed.select(F.col("id").alias("_seed")).distinct()
    marked = tree.join(ids, F.col("id") == F.col("_seed"), "left").withColumn("_stop", F.col("_seed").isNotNull()).drop("_seed")
    ways = path_sums(marked, {}, F.col("_stop"))
    met = ways.join(ids, F.col("root") == F.col("_seed"), "left_semi")
    return met.select("id", F.col("steps").cast("int").alias("depth"))


def sub_basins(tree: DataFrame, outlets: DataFrame) -> DataFrame:
    """Each unit with the first outlet on its way down (itself included); units that meet none are absent."""
    ids = outlets.select(F.col("id").alias("outlet")).distinct()
    marked = tree.join(ids, F.col("id") == F.col("outlet"), "left").withColumn("_stop", F.col("outlet").isNotNull()).drop("outlet")
    ways = path_sums(marked, {}, F.col("_stop")).select("id", F.col("root").alias("outlet"))
    return ways.join(ids, "outlet", "left_semi").select("id", "outlet")


def accumulate(tree: DataFrame, value: Column) -> DataFrame:
    """id and total: the value of each unit and of all that drain to it; cycles have a null total.

    Pointers and sums double their reach together, so a chain of n units takes log2(n) rounds. A round
    sums by the unit that a pointer meets, combined map-side.
    """
    from freshet.operators.lineage import Written

    ids = tree.select(F.col("id").alias("_known"))
    held = Written(tree.join(ids, F.col("next") == F.col("_known"), "left").select("id", F.col("_known").alias("to"), value.cast("decimal(28,6)").alias("total")))
    state = held.table
    reach, units = 1, state.count()
    while reach <= units and not state.where("to is not null").isEmpty():
        gain = state.where("to is not null").groupBy(F.col("to").alias("_at")).agg(F.sum("total").cast("decimal(28,6)").alias("_gain"))
        ahead = state.where("to is not null").select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        grown = state.join(gain, F.col("id") == F.col("_at"), "left").join(ahead, F.col("to") == F.col("_id"), "left")
        next_ = Written(grown.select("id", F.col("_to").alias("to"), (F.col("total") + F.coalesce("_gain", F.lit(0))).cast("decimal(28,6)").alias("total")))
        held.drop()
        held, state = next_, next_.table
        reach *= 2
    return state.select("id", F.when(F.col("to").isNull(), F.col("total").cast("double")).alias("total"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by undirected edges; nodes without edges are absent.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); a round is a few grouped
    minima and merge joins, so hubs are combined map-side and split by AQE, and nothing is sent through the driver.
    Stars about their smallest node need no round.
    """
    from freshet.operators.lineage import Written, release

    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u <> v").distinct()
    held = Written(e)
    while True:
        e = held.table
        ends = e.select(F.col("v").alias("x"), F.lit(1).alias("up")).union(e.select("u", F.lit(0)))
        open_ = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or (ups = 1 and n > 1)")
        if open_.isEmpty():
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", "u").distinct())
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select("u", "v"))
        low = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
        large = both.join(low.hint("merge"), "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        # a node that is its neighbours' minimum keeps its links through them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least.hint("merge"), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", "m"))
        next_ = Written(small.where("u <> v").distinct())
        held.drop()
        held = next_
        release(e)


def hydro_table(units: DataFrame) -> DataFrame:
    """id, next, area to id, next_down (-1: outlet or outside), area."""
    ids = units.select(F.col("id").alias("_down"))
    return units.join(ids, F.col("next") == F.col("_down"), "left").select("id", F.coalesce("_down", F.lit(-1).cast("long")).alias("next_down"), "area")


def streams_per_order(reaches: DataFrame) -> DataFrame:
    """Streams and reaches of each order; a reach that carries on a stream of its order is no new one."""
    above = reaches.select(F.col("next").alias("_id"), F.col("order").alias("_order")).distinct()
    first = reaches.join(above, (F.col("id") == F.col("_id")) & (F.col("order") == F.col("_order")), "left_anti")
    streams = first.groupBy("order").agg(F.count("*").alias("streams"))
    return reaches.groupBy("order").agg(F.count("*").alias("reaches")).join(streams, "order", "left").select("order", "reaches", F.coalesce("streams", F.lit(0).cast("long")).alias("streams"))


def path_sums(tree: DataFrame, weights: dict[str, Column], stops: Column | None = None) -> DataFrame:
    """id, root, steps and the sum of each weight over the way from id down to its root, the root's own left out.

    A root has no next, a next outside the table, or is a stop. Pointers double their reach each round,
    so a chain of n units takes log2(n) joins, and units that have arrived join no more, which keeps a
    root from becoming a hot key. A way that never arrives (a cycle) has a null root and null sums.
    """
    from freshet.operators.lineage import Written

    ids = tree.select(F.col("id").alias("_known"))
    end = F.col("_known").isNull() if stops is None else F.col("_known").isNull() | F.coalesce(stops, F.lit(False))
    start = tree.join(ids.hint("merge"), F.col("next") == F.col("_known"), "left").withColumn("_end", end)
    names = ["steps", *weights]
    each = {"steps": F.lit(1), **weights}
    start = start.select("id", F.when(F.col("_end"), F.col("id")).otherwise(F.col("next")).alias("to"), F.col("_end").alias("done"), *[F.when(F.col("_end"), 0).otherwise(w).alias(n) for n, w in each.items()])
    held = Written(start.select("id", "to", "done", *[F.col(n).cast("long" if n == "steps" else "double").alias(n) for n in names]))
    state = held.table
    reach, units = 1, state.count()
    while reach <= units and not state.where("not done").isEmpty():
        ahead = state.select(F.col("id").alias("_at"), F.col("to").alias("_to"), F.col("done").alias("_done"), *[F.col(n).alias(f"_{n}") for n in names])
        moved = state.where("not done").join(ahead.hint("merge"), F.col("to") == F.col("_at"))
        moved = moved.select("id", F.col("_to").alias("to"), F.col("_done").alias("done"), *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])
        next_ = Written(state.where("done").union(moved))
        held.drop()
        held, state = next_, next_.table
        reach *= 2
    return state.select("id", F.when(F.col("done"), F.col("to")).alias("root"), *[F.when(F.col("done"), F.col(n)).alias(n) for n in names])


def path_window(tree: DataFrame, value: Column, n: int) -> DataFrame:
    """id, total and count of a value over the next n units down from each unit, itself left out; fewer where the way ends.

    Sums over 1, 2, 4, ... units are made of each other, and n of those it is the sum of, so n takes
    2 log2(n) joins. Nulls don't count. Totals are decimals and don't depend on the order of rows.
    """
    from freshet.operators.lineage import Written

    v = value.cast("decimal(20,6)")
    ahead = tree.select(F.col("id").alias("_id"), F.coalesce(v, F.lit(0)).cast("decimal(28,6)").alias("s"), v.isNotNull().cast("int").alias("c"))
    power = Written(tree.join(ahead, F.col("next") == F.col("_id")).select("id", F.col("_id").alias("to"), "s", "c"))
    out = Written(tree.select("id", F.col("id").alias("at"), F.lit(0).cast("decimal(28,6)").alias("total"), F.lit(0).alias("count")))
    left = n
    while left:
        step = power.table.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("s").alias("_s"), F.col("c").alias("_c"))
        if left % 2:
            met = out.table.join(step, F.col("at") == F.col("_id"), "left")
            new = Written(met.select("id", F.col("_to").alias("at"), (F.col("total") + F.coalesce("_s", F.lit(0))).cast("decimal(28,6)").alias("total"), (F.col("count") + F.coalesce("_c", F.lit(0))).alias("count")))
            out.drop()
            out = new
        left //= 2
        if left:
            # a way that ends before is summed up to its end
            met = power.table.join(step, F.col("to") == F.col("_id"), "left")
            new = Written(met.select("id", F.col("_to").alias("to"), (F.col("s") + F.coalesce("_s", F.lit(0))).cast("decimal(28,6)").alias("s"), (F.col("c") + F.coalesce("_c", F.lit(0))).alias("c")))
            power.drop()
            power = new
    power.drop()
    return out.table.select("id", "total", "count")


def main_upstream(tree: DataFrame, area: Column) -> DataFrame:
    """id and next, where next is the unit with the largest area of those that drain to id, ties to the larger id; null at a source."""
    best = tree.where("next is not null").groupBy(F.col("next").alias("_below")).agg(F.max(F.struct(area.alias("a"), "id"))["id"].alias("_best"))
    return tree.select("id").join(best, F.col("id") == F.col("_below"), "left").select("id", F.col("_best").alias("next"))


def routing_check(tree: DataFrame) -> DataFrame:
    """One row: units, terminal_units, dangling_next, units_in_a_cycle (or on the way into one), single_outlet."""
    walked = path_sums(tree, {}).select("id", F.col("root").isNull().alias("lost"))
    ids = tree.select(F.col("id").alias("_known"))
    marked = tree.join(walked, "id").join(ids, F.col("next") == F.col("_known"), "left")
    counts = marked.agg(
        F.count("*").alias("units"), F.count_if(F.col("next").isNull()).alias("terminal_units"),
        F.count_if(F.col("next").isNotNull() & F.col("_known").isNull()).alias("dangling_next"), F.count_if("lost").alias("units_in_a_cycle"),
    )
    return counts.withColumn("single_outlet", (F.col("terminal_units") == 1) & (F.col("dangling_next") == 0) & (F.col("units_in_a_cycle") == 0))


def main_stem(reaches: DataFrame) -> DataFrame:
    """id and distance to the outlet of the reaches on the main stem of each tree (id, next, area, length).

    From an outlet the stem climbs to the reach with the largest area, ties to the larger id. A reach
    is on it when no step of its way down comes from a reach that is not the largest above its next.
    """
    best = reaches.where("next is not null").groupBy(F.col("next").alias("_below")).agg(F.max(F.struct("area", "id"))["id"].alias("_best"))
    marked = reaches.join(best, F.col("next") == F.col("_below"), "left")
    ways = path_sums(marked, {"aside": F.when(F.col("id") == F.col("_best"), 0).otherwise(1), "distance": F.col("length")})
    return ways.where("aside = 0").select("id", F.round("distance", 6).alias("distance"))


def tributaries(reaches: DataFrame, stem: DataFrame) -> DataFrame:
    """Reaches outside the stem that flow into it: id, joins, area, share of the area of the reach they join."""
    on = stem.select(F.col("id").alias("_on"))
    side = reaches.join(on, F.col("id") == F.col("_on"), "left_anti")
    main = reaches.join(on, F.col("id") == F.col("_on"), "left_semi").select(F.col("id").alias("joins"), F.col("area").alias("_main"))
    return side.join(main, F.col("next") == F.col("joins")).select("id", "joins", "area", F.try_divide(F.col("area").cast("double"), F.col("_main")).alias("share"))


def order_table(reaches: DataFrame) -> DataFrame:
    """By order: reaches, streams, length, mean length of a stream, bifurcation and length ratios to the order above or below."""
    length = reaches.groupBy("order").agg(F.sum(F.col("length").cast("decimal(18,4)")).cast("double").alias("length"))
    by = streams_per_order(reaches).join(length, "order").withColumn("mean_length", F.try_divide("length", "streams"))
    line = Window.orderBy("order")  # as many rows as orders
    return by.select(
        "*",
        F.try_divide(F.col("streams").cast("double"), F.lead("streams").over(line)).alias("bifurcation_ratio"),
        F.try_divide("mean_length", F.lag("mean_length").over(line)).alias("length_ratio"),
    )


def long_profile(points: DataFrame) -> DataFrame:
    """(river, seq, length, z) in downstream order to distance before each point, z with gaps filled, and the falling bed."""
    down = Window.partitionBy("river").orderBy("seq")
    before, whole = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    distance = F.coalesce(F.sum(F.col("length").cast("decimal(18,4)")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    # only points before the first height lack one before them; a frame from each row to the end would be read anew for each row
    filled = F.coalesce(F.last("z", True).over(before), F.first("z", True).over(whole))
    rows = points.select("river", "seq", distance.alias("distance"), filled.alias("z"))
    return rows.withColumn("bed", F.min("z").over(before))


def numbered(units: DataFrame, key: str = "id") -> DataFrame:
    """units with number, 1 to n in ascending order of the key, in steps by range so that no task sorts all of them."""
    from freshet.operators.lineage import checkpoint

    parts = checkpoint(units.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    size = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = size.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parts.join(F.broadcast(before), "_part").withColumn("number", (place + F.col("_before")).cast("long")).drop("_part", "_before")


def arc_hydro(units: DataFrame) -> DataFrame:
    """hydro_id (1 to n by id), hydro_code, next_down_id (-1 where it is 0, null or outside) and area_km2 of (id, next, area)."""
    table = numbered(units)
    below = table.select(F.col("id").alias("_id"), F.col("number").alias("_number"))
    out = table.join(below, F.col("next") == F.col("_id"), "left")
    return out.select(F.col("number").alias("hydro_id"), F.col("id").cast("string").alias("hydro_code"), F.coalesce("_number", F.lit(-1).cast("long")).alias("next_down_id"), F.col("area").cast("double").alias("area_km2"))


def unit_setting(units: DataFrame) -> DataFrame:
    """(id, sub_area, up_area, endo, coast) with flags: endorheic, coastal, nothing_upstream (up and sub area less than 0.51 apart)."""
    return units.select(
        "id", "up_area", (F.coalesce("endo", F.lit(0)) > 0).alias("endorheic"), (F.coalesce("coast", F.lit(0)) > 0).alias("coastal"),
        F.coalesce(F.abs(F.col("up_area") - F.col("sub_area")) < 0.51, F.lit(False)).alias("nothing_upstream"),
    )


def largest(units: DataFrame, by: str, n: int, key: str = "id") -> DataFrame:
    """The n rows with the most of `by`, ties by the smaller key, with their place."""
    top = units.orderBy(F.col(by).desc_nulls_last(), key).limit(n)  # n rows are kept from each partition, and n of them
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), key)).cast("int"))
