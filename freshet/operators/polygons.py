"""Polygons as tables of directed edges (poly, ring, x1, y1, x2, y2); outer rings run counterclockwise, holes clockwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Semi-major axis in metres and squared eccentricity of WGS84.
A, E2 = 6378137.0, 0.0066943799901413165
E = E2**0.5


def edges(rings: DataFrame) -> DataFrame:
    """Edges of vertices (poly, ring, seq, x, y); a ring closes by itself, edges without length are left out."""
    w = Window.partitionBy("poly", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = [F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(n) for c, n in (("x", "x2"), ("y", "y2"))]
    return rings.select("poly", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), *ahead).where("x1 <> x2 or y1 <> y2")


def _authalic(lat: str) -> str:
    """q of a latitude in degrees, as SQL for Spark and others: twice the area below it on a unit ellipsoid, over its width."""
    s = f"sin(radians({lat}))"
    return f"({1 - E2!r} * ({s} / (1 - {E2!r} * {s} * {s}) - 1 / (2 * {E!r}) * ln((1 - {E!r} * {s}) / (1 + {E!r} * {s}))))"


def equal_area_sql(lon: str, lat: str, lon0: str, lat0: str) -> tuple[str, str]:
    """x and y in metres of the Lambert azimuthal equal-area projection about (lon0, lat0), as SQL (Snyder, 1987, 24-17 to 24-26)."""
    pole = f"({1 - E2!r} * (1 / {1 - E2!r} - 1 / (2 * {E!r}) * ln((1 - {E!r}) / (1 + {E!r}))))"
    sb, sb0 = f"({_authalic(lat)} / {pole})", f"({_authalic(lat0)} / {pole})"
    cb, cb0 = f"sqrt(1 - {sb} * {sb})", f"sqrt(1 - {sb0} * {sb0})"
    dl = f"radians(({lon}) - ({lon0}))"
    rq = f"({A!r} * sqrt({pole} / 2))"
    s0 = f"sin(radians({lat0}))"
    d = f"({A!r} * cos(radians({lat0})) / sqrt(1 - {E2!r} * {s0} * {s0}) / ({rq} * {cb0}))"
    b = f"({rq} * sqrt(2 / (1 + {sb0} * {sb} + {cb0} * {cb} * cos({dl}))))"
    return f"({b} * {d} * {cb} * sin({dl}))", f"({b} / {d} * ({cb0} * {sb} - {sb0} * {cb} * cos({dl})))"


def projected(rings: DataFrame, centres: DataFrame) -> DataFrame:
    """Vertices (poly, ring, seq, x: longitude, y: latitude) in metres about the centre (poly, lon0, lat0) of each polygon.

    A centre outside the globe gives no rows.
    """
    good = centres.where("lon0 between -180 and 180 and lat0 between -90 and 90")
    x, y = equal_area_sql("x", "y", "lon0", "lat0")
    return rings.join(good, "poly").select("poly", "ring", "seq", F.expr(x).alias("x"), F.expr(y).alias("y"))


def measures(edge_table: DataFrame) -> DataFrame:
    """poly, area, perimeter, box_efficiency (area over that of the bounding box) in the units of the edges."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    by = edge_table.groupBy("poly").agg(
        (F.abs(F.sum(cross)) / 2).alias("area"), F.sum(length).alias("perimeter"), ((F.max("x1") - F.min("x1")) * (F.max("y1") - F.min("y1"))).alias("box")
    )
    return by.select("poly", "area", "perimeter", F.round(F.try_divide("area", "box"), 6).alias("box_efficiency"))


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def points_in(points: DataFrame, edge_table: DataFrame, cell: float) -> DataFrame:
    """id and poly of each point (id, x, y) inside a polygon, holes left out.

    A ray to the east crosses an odd number of edges. Edges are dealt to the rows of cells that they pass
    and points meet those of their own row, so nothing is compared across rows. Points that lie
    on an edge count for the lower and left side.
    """
    p = points.select("id", "x", "y", F.floor(F.col("y") / cell).alias("band"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edge_table.where("y1 <> y2").withColumn("band", F.explode(_cells(low, high, cell)))
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (
        F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    )
    hit = p.join(e, "band").where(crosses).groupBy("id", "poly").agg(F.count("*").alias("n"))
    return hit.where("n % 2 = 1").select("id", "poly")


def clip(cells: DataFrame, edge_table: DataFrame, poly: object, cell: float) -> DataFrame:
    """cells (layer, row, col, x, y, value) whose centre lies in the polygon, and the smallest grid about them: others are nodata."""
    inside = points_in(cells.select(F.struct("layer", "row", "col").alias("id"), "x", "y"), edge_table.where(F.col("poly") == F.lit(poly)), cell).select("id.*")
    frame = inside.groupBy("layer").agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])
    kept = cells.join(frame, "layer").where(F.col("row").between(F.col("lo_row"), F.col("hi_row")) & F.col("col").between(F.col("lo_col"), F.col("hi_col")))
    marked = kept.join(inside.withColumn("_in", F.lit(True)), ["layer", "row", "col"], "left")
    return marked.select("layer", "row", "col", F.when(F.col("_in"), F.col("value")).alias("value"))


def lines_meet(lines: DataFrame, edge_table: DataFrame, cell: float) -> DataFrame:
    """id and poly of each line segment (id, x1, y1, x2, y2) that meets a polygon: crosses or touches an edge, or lies in it.

    Boxes of both are dealt to cells, so only neighbours are tested.
    """
    a = lines.select("id", *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    box = lambda t, x1, y1, x2, y2: (
        t.withColumn("cx", F.explode(_cells(F.least(x1, x2), F.greatest(x1, x2), cell))).withColumn("cy", F.explode(_cells(F.least(y1, y2), F.greatest(y1, y2), cell)))
    )
    near = box(a, "ax1", "ay1", "ax2", "ay2").join(box(edge_table, "x1", "y1", "x2", "y2"), ["cx", "cy"])
    side = lambda px, py, qx, qy, rx, ry: F.signum((F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px)))
    cut = (side("ax1", "ay1", "ax2", "ay2", "x1", "y1") * side("ax1", "ay1", "ax2", "ay2", "x2", "y2") <= 0) & (side("x1", "y1", "x2", "y2", "ax1", "ay1") * side("x1", "y1", "x2", "y2", "ax2", "ay2") <= 0)
    # segments of one straight line meet where their boxes do
    box_meets = [F.greatest(F.least(f"a{c}1", f"a{c}2"), F.least(f"{c}1", f"{c}2")) <= F.least(F.greatest(f"a{c}1", f"a{c}2"), F.greatest(f"{c}1", f"{c}2")) for c in "xy"]
    crossing = near.where(cut & box_meets[0] & box_meets[1]).select("id", "poly")
    starts = points_in(lines.select("id", F.col("x1").alias("x"), F.col("y1").alias("y")), edge_table, cell)
    return crossing.union(starts).distinct()


def dissolve(edge_table: DataFrame, group: DataFrame, digits: int = 6) -> DataFrame:
    """Edges of the union of each group's polygons (poly, grp): those that no neighbour runs through the other way.

    Corners that agree to `digits` are one, which welds slivers. Polygons of a group must share whole edges.
    """
    r = [F.round(c, digits).alias(c) for c in ("x1", "y1", "x2", "y2")]
    e = edge_table.join(group, "poly").select("grp", *r).where("x1 <> x2 or y1 <> y2")
    forward = F.struct("x1", "y1") < F.struct("x2", "y2")
    pair = e.select("grp", F.when(forward, F.struct("x1", "y1", "x2", "y2")).otherwise(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))).alias("e"), F.when(forward, 1).otherwise(-1).alias("way"))
    left = pair.groupBy("grp", "e").agg(F.sum("way").alias("way")).where("way <> 0")
    ahead = F.col("way") > 0
    turned = [F.when(ahead, F.col(f"e.{c}")).otherwise(F.col(f"e.{d}")).alias(c) for c, d in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return left.select(F.col("grp").alias("poly"), F.lit(0).alias("ring"), *turned)


def mask_outline(cells: DataFrame, inside: Column) -> DataFrame:
    """Edges about the cells (layer, row, col) that lie inside, a cell being one unit wide, row 0 at the top."""
    on = cells.where(inside).select("layer", "row", "col")
    corners = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("x1", "y1", "x2", "y2"), strict=True)]) for s in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))])
    each = on.select("layer", "row", "col", F.explode(corners).alias("s"))
    shift = [(F.col(f"s.{n}") + (F.col("col") if n[0] == "x" else -F.col("row") - 1)).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")]
    own = each.select(F.col("layer").alias("poly"), F.lit(0).alias("ring"), *shift)
    return dissolve(own, on.select(F.col("layer").alias("poly"), F.col("layer").alias("grp")).distinct())


def outline(rings: DataFrame, most: int = 1000) -> DataFrame:
    """poly, ring, seq, x, y: polygons of more than `most` vertices as their convex hull, which holds them; others as they are.

    Each batch sends the corners of its own points only, so no polygon meets whole in one task.
    """
    from freshet.operators.morphometry import hull_corners

    size = rings.groupBy("poly").agg(F.count("*").alias("_n"))
    both = rings.join(size, "poly")
    hull = hull_corners(both.where(F.col("_n") > most).select(F.col("poly").alias("basin"), "x", "y"))
    hull = hull.select(F.col("basin").alias("poly"), F.lit(0).alias("ring"), F.col("seq").cast(dict(rings.dtypes)["seq"]).alias("seq"), "x", "y")
    return both.where(F.col("_n") <= most).select("poly", "ring", "seq", "x", "y").union(hull)
