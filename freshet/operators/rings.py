"""Edges to polygons: edges welded and split where they meet, unions of polygons, rings put together, holes dealt.

Edges are (poly, ring, x1, y1, x2, y2) with the inside on their left. A boundary of any length is a table
of edges until the end: rings come from pointers between chains of edges, which double their reach, and no polygon
meets in one task.
Both sides of a join grow with the edges, so all joins ask for a merge: none is sent through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.lineage import written
from freshet.operators.network import components, path_sums
from freshet.operators.polygons import edges as closed_edges

_ENDS = ("x1", "y1", "x2", "y2")


def _point(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def weld(edge_table: DataFrame, within: float, key: str = "poly") -> DataFrame:
    """The edges with corners of one key that lie within a distance of each other, or of ones that do, made one: the least of them."""
    corners = edge_table.select(key, F.explode(F.array(_point("x1", "y1"), _point("x2", "y2"))).alias("p")).distinct()
    near = corners.select(key, "p", *[F.floor(F.col(f"p.{c}") / within).alias(f"c{c}") for c in "xy"])
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    other = near.select(key, F.col("p").alias("q"), "cx", "cy").select("*", around.alias("dx")).select("*", around.alias("dy"))
    other = other.select(key, "q", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    apart = F.sqrt(F.pow(F.col("p.x") - F.col("q.x"), 2) + F.pow(F.col("p.y") - F.col("q.y"), 2))
    pairs = near.join(other.hint("merge"), [key, "cx", "cy"]).where((F.col("q") < F.col("p")) & (apart <= within))
    node = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("p"))
    moved = components(pairs.select(node("p").alias("a"), node("q").alias("b"))).select(F.col("node").alias("n"), F.col("component.p").alias("m"))
    out = edge_table
    for x, y in (("x1", "y1"), ("x2", "y2")):
        at = F.struct(F.col(key).alias("k"), _point(x, y).alias("p"))
        both = out.withColumn("_n", at).join(moved.hint("merge"), F.col("_n") == F.col("n"), "left")
        out = both.withColumns({x: F.coalesce("m.x", F.col(x)), y: F.coalesce("m.y", F.col(y))}).drop("_n", "n", "m")
    return out.where("x1 <> x2 or y1 <> y2")


def _spans(t: DataFrame, cell: float, out: float) -> DataFrame:
    """Each edge in every cell of a grid that its box, made wider by `out`, touches."""
    box = lambda a, b: F.sequence(F.floor((F.least(a, b) - out) / cell), F.floor((F.greatest(a, b) + out) / cell))
    return t.withColumn("cx", F.explode(box("x1", "x2"))).withColumn("cy", F.explode(box("y1", "y2")))


def node(edge_table: DataFrame, within: float, key: str = "poly", cell: float | None = None) -> DataFrame:
    """The edges of each key, split at every corner within a distance of them and where they cross each other.

    A piece runs through the corner itself, so an edge may bend by `within`. cell: side of the grid in
    which edges meet; twice their mean extent if None.
    """
    if cell is None:
        extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
        cell = max(2 * (edge_table.agg(F.avg(extent)).first()[0] or 1.0), 4 * within)
    e = written(edge_table.withColumn("_e", F.monotonically_increasing_id()))
    long = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    spans = _spans(e.select(key, "_e", *_ENDS), cell, within)
    corners = e.select(key, F.explode(F.array(_point("x1", "y1"), _point("x2", "y2"))).alias("p")).distinct()
    corners = corners.withColumns({"cx": F.floor(F.col("p.x") / cell), "cy": F.floor(F.col("p.y") / cell)})
    ux, uy = (F.col("x2") - F.col("x1")) / long, (F.col("y2") - F.col("y1")) / long
    along = (F.col("p.x") - F.col("x1")) * ux + (F.col("p.y") - F.col("y1")) * uy
    aside = F.abs((F.col("p.x") - F.col("x1")) * uy - (F.col("p.y") - F.col("y1")) * ux)
    inner = F.col("p").isNotNull() & (F.col("p") != _point("x1", "y1")) & (F.col("p") != _point("x2", "y2"))
    on = spans.join(corners.hint("merge"), [key, "cx", "cy"]).where(inner & (aside <= within) & (along > 0) & (along < long)).select("_e", "p", (along / long).alias("t"))
    a = spans.select(key, "cx", "cy", F.col("_e").alias("_f"), *[F.col(c).alias(f"a{c}") for c in _ENDS])
    turn = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    s1, s2 = turn("ax1", "ay1", "ax2", "ay2", "x1", "y1"), turn("ax1", "ay1", "ax2", "ay2", "x2", "y2")
    s3, s4 = turn("x1", "y1", "x2", "y2", "ax1", "ay1"), turn("x1", "y1", "x2", "y2", "ax2", "ay2")
    met = spans.join(a.hint("merge"), [key, "cx", "cy"]).where((F.col("_e") < F.col("_f")) & (s1 * s2 < 0) & (s3 * s4 < 0)).dropDuplicates(["_e", "_f"])
    t, u = s1 / (s1 - s2), s3 / (s3 - s4)
    p = F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))
    met = written(met.select("_e", "_f", p.alias("p"), t.alias("t"), u.alias("u")))
    cuts = on.union(met.select("_e", "p", "t")).union(met.select("_f", "p", "u"))
    cuts = cuts.groupBy("_e").agg(F.array_sort(F.collect_set(F.struct("t", "p"))).alias("cuts"))
    whole = e.join(cuts.hint("merge"), "_e", "left").withColumn("way", F.concat(F.array(_point("x1", "y1")), F.coalesce(F.transform("cuts", lambda c: c["p"]), F.array().cast("array<struct<x:double,y:double>>")), F.array(_point("x2", "y2"))))
    pieces = whole.withColumn("s", F.explode(F.arrays_zip(F.slice("way", 1, F.size("way") - 1).alias("a"), F.slice("way", 2, F.size("way") - 1).alias("b"))))
    rest = [c for c in edge_table.columns if c not in _ENDS]
    return pieces.select(*rest, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")).where("x1 <> x2 or y1 <> y2")


def _crosses() -> Column:
    """Whether a ray from (x, y) to the east crosses an edge."""
    east = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < east)


def _winding(points: DataFrame, edge_table: DataFrame, cell: float) -> DataFrame:
    """id and how often the edges of its poly run round each point (id, poly, x, y); 0 is absent."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edge_table.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    p = points.withColumn("band", F.floor(F.col("y") / cell))
    hit = p.join(e.hint("merge"), ["poly", "band"]).where(_crosses()).groupBy("id").agg(F.sum(F.when(F.col("y2") > F.col("y1"), 1).otherwise(-1)).alias("turns"))
    return hit.where("turns <> 0")


def union(edge_table: DataFrame, group: DataFrame, within: float = 1e-5, overlaps: bool = True) -> DataFrame:
    """Edges (poly, ring, x1, y1, x2, y2) of the union of each group's polygons (poly, grp); poly is the group.

    Corners closer than `within` are one and edges are split where they meet, so neighbours need not share
    whole edges and slivers up to that width close. Then edges that run both ways cancel, and so do those
    with the union on both sides, unless overlaps is false. A polygon may be in one group only.
    """
    own = edge_table.join(group.hint("merge"), "poly").select(F.col("grp").alias("poly"), *_ENDS)
    # pieces that bend through a corner may come close to another: until no edge is split any more
    pieces = written(weld(own, within))
    count = pieces.count()
    while True:
        pieces = written(weld(node(pieces, within), within))
        now = pieces.count()
        if now == count:
            break
        count = now
    ahead = _point("x1", "y1") < _point("x2", "y2")
    turned = [F.when(ahead, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(_ENDS, ("x2", "y2", "x1", "y1"), strict=True)]
    net = pieces.select("poly", *turned, F.when(ahead, 1).otherwise(-1).alias("way")).groupBy("poly", *_ENDS).agg(F.sum("way").alias("way")).where("way <> 0")
    back = [F.when(F.col("way") > 0, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(_ENDS, ("x2", "y2", "x1", "y1"), strict=True)]
    left = written(net.select("poly", F.lit(0).alias("ring"), *back))
    if not overlaps:
        return left
    left = written(left.withColumn("id", F.monotonically_increasing_id()))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = within / 4 / F.sqrt(dx * dx + dy * dy)
    beside = left.select("id", "poly", ((F.col("x1") + F.col("x2")) / 2 + dy * out).alias("x"), ((F.col("y1") + F.col("y2")) / 2 - dx * out).alias("y"))
    height = left.agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 1.0
    covered = _winding(beside, pieces.select("poly", *_ENDS), 4 * height).where("turns > 0").select("id")
    return left.join(covered.hint("merge"), "id", "left_anti").select("poly", "ring", *_ENDS)


def _corners(e: DataFrame) -> DataFrame:
    """A row for each corner (poly, x2, y2): how many edges end and begin there, and one of each; they are id and next where ins and outs are 1."""
    none = lambda *names: [F.lit(None).cast("long" if n in ("id", "next") else "double").alias(n) for n in names]
    end = e.select("poly", "x2", "y2", F.lit(1).alias("ins"), F.lit(0).alias("outs"), "id", "x1", "y1", *none("next", "bx", "by"))
    start = e.select("poly", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.lit(0), F.lit(1), *none("id", "x1", "y1"), F.col("id").alias("next"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    return end.union(start).groupBy("poly", "x2", "y2").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), *[F.min(c).alias(c) for c in ("id", "x1", "y1", "next", "bx", "by")])


def _successors(into: DataFrame, out: DataFrame, among: list[str], widest: bool) -> DataFrame:
    """id, next, bx, by: of the edges out the one that goes on from the end of each edge into it, and where that one ends; `among` must agree.

    Seen from the end of an edge, backwards, and clockwise: the first edge out, which keeps pieces of the
    inside apart that meet in a corner, or with widest the last one.
    """
    at = into.select("id", *among, _point("x2", "y2").alias("p"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("back"))
    on = out.select(F.struct(F.col("id").alias("next"), F.col("x2").alias("bx"), F.col("y2").alias("by")).alias("n"), *among, _point("x1", "y1").alias("p"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("on"))
    turn = F.pmod(F.col("back") - F.col("on"), F.lit(2 * math.pi))
    turn = F.when(turn <= 1e-12, 2 * math.pi).otherwise(turn)
    pick = F.max_by if widest else F.min_by
    return at.join(on.hint("merge"), [*among, "p"]).groupBy("id").agg(pick("n", F.struct(turn, "n")).alias("n")).select("id", "n.*")


_CHAIN = "head long, before long, to long, least long, marks long, twice double, cx double, cy double, ex double, ey double, cm long"


def _chained(batches):
    """Of a batch of links the chains that lie in it: head and marks before it for each row, and for the first of a chain what the chain comes to."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, nxt, mark, fork, x1, y1, x2, y2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "next", "mark", "fork", *_ENDS))
        every, by = np.arange(n), np.argsort(ids)
        j = by[np.minimum(np.searchsorted(ids, nxt, sorter=by), n - 1)]
        here = (ids[j] == nxt) & ~fork[j]
        back = np.full(n, -1)
        back[j[here]] = np.flatnonzero(here)
        while True:
            root, least, steps = np.where(back < 0, every, back), every, (back >= 0).astype(np.int64)
            for _ in range(n.bit_length()):
                least, steps, root = np.minimum(least, least[root]), steps + steps[root], root[root]
            ring = back[root] >= 0
            if not ring.any():
                break
            back[ring & (least == every)] = -1  # a cycle within the batch is opened at one of its rows
        order = np.lexsort((steps, root))
        chain = root[order]
        first = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
        number = np.cumsum(np.append(False, chain[1:] != chain[:-1]))
        m = mark[order].astype(np.int64)
        before = np.cumsum(m) - m
        before -= before[first][number]
        corner = np.lexsort((y1[order], x1[order], number))[first]
        cross = (x1 * y2 - x2 * y1)[order]
        ends = nxt[order][np.append(first[1:], n) - 1]
        of = [ends, np.minimum.reduceat(ids[order], first), np.add.reduceat(m, first), np.add.reduceat(cross, first), *[v[order][corner] for v in (x1, y1, x2, y2)], before[corner]]
        rest = np.ones(n, bool)
        rest[first] = False
        wide = [pa.array(v[number], mask=rest) for v in of]
        own = b.take(pa.array(order)).select([c for c in b.schema.names if c not in ("next", "fork")])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids[chain]), pa.array(before), *wide], names=[*own.schema.names, *[c.split()[0] for c in _CHAIN.split(", ")]])


def _chains(links: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """The edges of links (poly, id, x1, y1, x2, y2, next, mark) with the head of their chain and the marks before them, and a row for each chain with its ring.

    Links are sorted by squares of the plane and whatever lies in one batch is chained there, so that pointers
    double over chains only: as many as the batches have links between them. Where batches end doesn't matter.
    """
    fork = links.groupBy("next").agg(F.count("*").alias("n")).where("n > 1").select(F.col("next").alias("id"), F.lit(True).alias("fork"))
    fork = written(fork)
    forked = not fork.isEmpty()  # edges that several go on to, of input that is no boundary: a chain begins there
    marked = links.join(fork.hint("merge"), "id", "left").withColumn("fork", F.coalesce("fork", F.lit(False))) if forked else links.withColumn("fork", F.lit(False))
    square = [F.floor(F.col(c) / cell) for c in ("y1", "x1")]
    names = [c for c in links.columns if c != "next"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.select(*names).schema.fields)
    near = marked.select(*names, "next", "fork").repartitionByRange("poly", *square, "id").sortWithinPartitions("poly", *square, "id")
    rows = written(near.mapInArrow(_chained, f"{kind}, {_CHAIN}"))
    chains = rows.where("to is not null").select("poly", *[c.split()[0] for c in _CHAIN.split(", ") if not c.startswith("before ")])
    alone = chains.where("to = head").select("head", F.col("least").alias("ring"))
    ring = alone.union(_cycles(chains.where("to <> head").select("head", "to", "least"), forked))
    return rows.drop(*[c for c in chains.columns if c not in ("poly", "head")]), written(chains.join(ring.hint("merge"), "head"))


def _cycles(links: DataFrame, forked: bool) -> DataFrame:
    """head and ring: the least of the cycle of each head; pointers double until all of a cycle agree. With forks, heads that only lead to a cycle are left out."""
    state = written(links)
    reach, size = 1, state.count()
    while size:
        ahead = state.select(F.col("head").alias("_head"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        both = written(state.join(ahead.hint("merge"), F.col("to") == F.col("_head")).select("head", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("least") != F.col("_least")).alias("open")))
        state = both.drop("open")
        reach *= 2
        if reach >= 2 * size or not forked and both.where("open").isEmpty():
            break
    if forked:
        state = state.join(state.select(F.col("to").alias("head")).distinct().hint("merge"), "head", "left_semi")
    return state.select("head", F.col("least").alias("ring"))


def assemble(edge_table: DataFrame, straight: bool = True) -> DataFrame:
    """poly, ring, seq, x, y, shell: the rings of directed edges, holes with the shell that holds them (a shell's is itself).

    Edges that form no closed ring are left out. Where a ring meets itself in a corner it is cut there, so
    every ring is simple: a hole may touch its shell, and two shells may touch. Rings are numbered from 0 in each
    polygon, shells first, by their first corner (the least). straight: corners without a turn are dropped.
    """
    e = edge_table.select("poly", *_ENDS).where("x1 <> x2 or y1 <> y2")
    taken = written(e.withColumn("id", F.monotonically_increasing_id()))
    while True:  # an edge that ends where none begins, or begins where none ends, is on no ring
        corners = written(_corners(taken))
        loose = corners.where("ins = 0 or outs = 0").select("poly", "x2", "y2")
        if loose.isEmpty():
            break
        kept = taken.join(loose.hint("merge"), ["poly", "x2", "y2"], "left_anti").join(loose.withColumnsRenamed({"x2": "x1", "y2": "y1"}).hint("merge"), ["poly", "x1", "y1"], "left_anti")
        taken = written(kept.select(*taken.columns))
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    cell = 32 * (taken.agg(F.avg(extent)).first()[0] or 1.0)
    dx, dy, dbx, dby = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("bx") - F.col("x2"), F.col("by") - F.col("y2")
    mark = (dx * dby != dy * dbx) | (dx * dbx + dy * dby < 0) if straight else F.lit(True)
    linked = lambda t: t.select("poly", "id", *_ENDS, "next", mark.alias("mark"))
    simple = linked(corners.where("ins = 1 and outs = 1"))
    crossing = corners.where("ins > 1 or outs > 1").select("poly", "x2", "y2")
    if crossing.isEmpty():
        rows, chains = _chains(simple, cell)
    else:
        into = written(taken.join(crossing.hint("merge"), ["poly", "x2", "y2"], "left_semi"))
        out = written(taken.join(crossing.withColumnsRenamed({"x2": "x1", "y2": "y1"}).hint("merge"), ["poly", "x1", "y1"], "left_semi"))
        others = written(into.join(_successors(into, out, ["poly"], False).hint("merge"), "id"))
        rows, chains = _chains(simple.union(linked(others)), cell)
        # a corner that a ring visits more than once: there it goes on by the last edge of its own in place of the first
        near = into.select("id").union(out.select("id")).distinct()
        ring = rows.select("id", "head").join(near.hint("merge"), "id").join(chains.select("head", "ring").hint("merge"), "head").select("id", "ring")
        ring = written(ring)
        into, out = (written(t.join(ring.hint("merge"), "id")) for t in (into, out))
        often = written(into.groupBy("poly", "ring", "x2", "y2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        if not often.isEmpty():
            again = into.join(often.hint("merge"), ["poly", "ring", "x2", "y2"], "left_semi")
            out = out.join(often.withColumnsRenamed({"x2": "x1", "y2": "y1"}).hint("merge"), ["poly", "ring", "x1", "y1"], "left_semi")
            swapped = _successors(again, out, ["poly", "ring"], True).select("id", *[F.col(c).alias(f"_{c}") for c in ("next", "bx", "by")])
            others = others.join(swapped.hint("merge"), "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("next", "bx", "by")})
            rows, chains = _chains(simple.union(written(linked(others))), cell)
    # a ring is opened before the edge that starts at its least corner, and corners are counted from there
    corner = F.struct("cx", "cy", "ex", "ey")
    info = chains.groupBy("poly", "ring").agg(F.min(corner).alias("e"), F.min_by("head", corner).alias("begin"), F.min_by("cm", corner).alias("cm"), F.sum("twice").alias("twice"), F.sum("marks").alias("size"))
    info = written(info)
    placed = written(chains.select("head", "to", "ring", "marks").join(info.select("ring", "begin", "cm", "size", (F.col("twice") > 0).alias("outer")).hint("merge"), "ring"))
    ways = path_sums(placed.select(F.col("head").alias("id"), F.when(F.col("to") != F.col("begin"), F.col("to")).alias("next"), "marks"), {"marks": F.col("marks")}).select(F.col("id").alias("head"), F.col("marks").alias("left"))
    ways = written(ways)
    placed = placed.join(ways.hint("merge"), "head").join(ways.select(F.col("head").alias("begin"), F.col("left").alias("all")).hint("merge"), "begin")
    rows = written(rows.join(placed.select("head", "ring", "outer", "size", (F.col("all") - F.col("left") - F.col("cm") + 1).cast("long").alias("shift")).hint("merge"), "head"))
    # a hole lies in the least shell that holds the middle of one of its edges, moved a little to the left
    dx, dy = F.col("e.ex") - F.col("e.cx"), F.col("e.ey") - F.col("e.cy")
    spot = info.where("twice < 0").select("poly", "ring", ((F.col("e.cx") + F.col("e.ex")) / 2 - dy * 1e-6).alias("x"), ((F.col("e.cy") + F.col("e.ey")) / 2 + dx * 1e-6).alias("y"))
    outer = rows.where("outer").select("poly", F.col("ring").alias("shell"), *_ENDS)
    height = outer.agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 1.0
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = outer.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(low / (4 * height)), F.floor(high / (4 * height)))))
    hit = spot.withColumn("band", F.floor(F.col("y") / (4 * height))).join(banded.hint("merge"), ["poly", "band"]).where(_crosses())
    held = hit.groupBy("ring", "shell").agg(F.count("*").alias("n")).where("n % 2 = 1").select("ring", "shell")
    held = held.join(info.select(F.col("ring").alias("shell"), "twice").hint("merge"), "shell").groupBy("ring").agg(F.min_by("shell", F.struct("twice", "shell")).alias("shell"))
    held = written(held)
    order = Window.partitionBy("poly").orderBy((F.col("twice") < 0).cast("int"), "e.cx", "e.cy", "twice", "ring")  # a row for each ring
    named = written(info.select("poly", "ring", "e", "twice").join(held.hint("merge"), "ring", "left").withColumn("number", F.row_number().over(order) - 1).withColumn("shell", F.coalesce("shell", "ring")))
    named = named.join(named.select(F.col("ring").alias("shell"), F.col("number").alias("of")).hint("merge"), "shell").select("ring", "number", "of")
    named = chains.select("head", "ring").join(named.hint("merge"), "ring").select("head", "number", "of")
    # the corner at the end of each edge; the one before the first edge is the last that is counted, and number 0
    rows = rows.where("mark").join(named.hint("merge"), "head")
    seq = F.pmod(F.col("before") + F.col("shift"), F.col("size")).cast("int")
    return rows.select("poly", F.col("number").cast("int").alias("ring"), seq.alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("of").cast("int").alias("shell"))


def edges(rings: DataFrame) -> DataFrame:
    """Edges of the rings that assemble() gives."""
    return closed_edges(rings.select("poly", "ring", "seq", "x", "y"))
