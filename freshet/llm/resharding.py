"""Resharding by minimum-cost flow: equal row counts, or given capacities, with the fewest bytes moved.

Each old shard orders its rows by size; a shard that has too many gives away its smallest rows. Which
shards take how many rows from which is the minimum-cost flow of a network of shards (never of rows),
solved on the driver. Rows find their shard and their slot from their rank in the old shard alone, so
the data is shuffled once, without texts, however many shards there are.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm import common as C

MOST_SHARDS = 4096


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> tuple[list[int], int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a maximum flow of least cost, and that cost.

    Successive shortest paths with potentials; each path takes its whole bottleneck.
    """
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, left, price = [], [], []
    for u, v, cap, cost in arcs:
        for a, b, c, p in ((u, v, cap, cost), (v, u, 0, -cost)):
            graph[a].append(len(to))
            to.append(b)
            left.append(c)
            price.append(p)
    height, total = [0] * nodes, 0
    while True:
        dist, via = [float("inf")] * nodes, [-1] * nodes
        dist[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in graph[u]:
                new = d + price[e] + height[u] - height[to[e]]
                if left[e] > 0 and new < dist[to[e]]:
                    dist[to[e]], via[to[e]] = new, e
                    heapq.heappush(queue, (new, to[e]))
        if via[sink] < 0:
            return [left[2 * i + 1] for i in range(len(arcs))], total
        height = [h + d if d < float("inf") else h for h, d in zip(height, dist, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push
            total += push * price[e]


def plan_transfers(counts: dict[int, int], room: list[tuple[int, int]], extra: int, last_size: dict[int, int] | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(old, lo, hi, shard, slot): rows of rank lo to hi - 1 of an old shard go to slots of a shard; and the bytes of the choice.

    Ranks are by size, smallest first. room: fewest and most rows of each new shard, one apart at most
    where they differ; extra: how many shards hold their most. An old shard keeps what it may and gives
    its smallest rows, which is the least that must move whatever the rest does. What is left to choose
    is which of the shards that give rows keep one more: last_size has, for each of them, the bytes of
    the row that this would save, and the flow pays them. The rows that leave are all alike to the
    shards that take them, so they pass through one node instead of an arc for each pair of shards.
    """
    shards = len(room)
    olds = sorted(k for k, n in counts.items() if n)
    src, pool, more, sink = 0, 1, 2, 3
    new_at = 4 + len(olds)
    arcs: list[tuple[int, int, int, int]] = []
    for at, k in enumerate(olds, 4):
        arcs.append((src, at, counts[k], 0))
        low, high = room[k] if k < shards else (0, 0)
        if high:
            arcs.append((at, new_at + k, high, 0))
        must = max(0, counts[k] - high)
        choice = max(0, min(high - low, counts[k] - low - must)) if must or counts[k] == high else 0
        size = (last_size or {}).get(k, 1)
        arcs += [(at, pool, must, 0), (at, pool, choice, size), (at, pool, counts[k] - must - choice, 1 << 50)]
    for j, (low, high) in enumerate(room):
        arcs += [(pool, new_at + j, high, 0), (new_at + j, sink, low, 0), (new_at + j, more, high - low, 0)]
    arcs.append((more, sink, extra, 0))
    flow, cost = min_cost_flow(new_at + shards, arcs, src, sink)
    stay, need = dict.fromkeys(olds, 0), dict.fromkeys(range(shards), 0)
    for (u, v, _, _), f in zip(arcs, flow, strict=True):
        if u == pool:
            need[v - new_at] += f
        elif 4 <= u < new_at <= v:
            stay[olds[u - 4]] += f
    segments, filled = [], {}
    for k in olds:
        gone = counts[k] - stay[k]
        if stay[k]:
            segments.append((k, gone, counts[k], k, 0))
        filled[k] = stay[k]
    takers = [[j, need[j], filled.get(j, 0)] for j in range(shards) if need[j]]
    for k in olds:
        lo, gone = 0, counts[k] - stay[k]
        while lo < gone:
            taker = takers[0]
            n = min(gone - lo, taker[1])
            segments.append((k, lo, lo + n, taker[0], taker[2]))
            lo, taker[1], taker[2] = lo + n, taker[1] - n, taker[2] + n
            if not taker[1]:
                takers.pop(0)
    return segments, cost


def reshard(
    docs: DataFrame, old_shard: F.Column, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", salts: int = 1024, carry: bool = False, capacities: list[int] | None = None
) -> DataFrame:
    """One row per document: id, size, text_crc32, law ('rows'), shard, slot, grown_shard, old_shard, moved.

    Without capacities, shards hold counts at most one apart (law 'rows'); with them (most rows of each
    new shard, law 'capacity'), shards give away only what is above theirs. Slots run from 0 without
    gaps, and the bytes that change shard are the fewest possible. A null text has no bytes (size 16,
    checksum 0); a null old shard is 0; rows without an id and repeated rows are rows like others. Ties
    of size are broken by a hash of id and text. No rows give no rows. carry: with the whole row as
    row, for rewrite_shards.
    """
    shards = len(capacities) if capacities is not None else shards
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, crc = (F.octet_length(text) + 16).cast("long"), F.crc32(text.cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        size.alias("size"),
        crc.alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old"),
        F.floor(F.log2(size) * 16).cast("int").alias("bin"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(salts)).cast("int").alias("salt"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    rows = C.checkpoint(rows)
    # ranks in two steps, so that an old shard is a few hundred rows in one task and its rows are dealt by size
    block = rows.groupBy("old", "bin", "size", "salt").agg(F.count("*").alias("n"))
    bins = rows.groupBy("old", "bin").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("old").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("old", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("below"))
    inside = Window.partitionBy("old", "bin").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bins, ["old", "bin"])
    block = C.checkpoint(block.select("old", "size", "salt", "n", (F.col("below") + F.col("inner")).alias("before")))
    counts = {r["old"]: r["n"] for r in block.groupBy("old").agg(F.sum("n").alias("n")).limit(MOST_SHARDS + 1).collect()}
    if len(counts) > MOST_SHARDS or shards > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards")
    total = sum(counts.values())
    if capacities is None:
        even, extra = divmod(total, shards)
        room = [(even, even + 1)] * shards
    else:
        if total > sum(capacities):
            raise ValueError(f"{total} rows for {sum(capacities)} places")
        # any shard may stay below its capacity: what is not needed is left free where it is free already
        free, room, extra = sum(capacities) - total, [], 0
        spare = [max(0, c - counts.get(j, 0)) for j, c in enumerate(capacities)]
        for c, s in zip(capacities, spare, strict=True):
            left = min(free, s)
            free -= left
            room.append((c - left, c - left))
    over = {k: n - room[k][1] for k, n in counts.items() if k < shards and n >= room[k][1] > room[k][0]}
    last = {}
    if over:
        edge = F.element_at(F.create_map(*[F.lit(x) for k, n in over.items() for x in (k, n)]), F.col("old"))
        hit = block.where(F.col("old").isin(list(over)) & (F.col("before") <= edge) & (edge < F.col("before") + F.col("n")))
        last = {r["old"]: r["size"] for r in hit.select("old", "size").collect()}
    segments, _ = plan_transfers(counts, room, extra, last)
    spark = docs.sparkSession
    plan = spark.createDataFrame(segments, "of int, lo long, hi long, shard int, first long")
    within = Window.partitionBy("old", "size", "salt").orderBy("id", "text_crc32")
    ranked = rows.withColumn("k", F.row_number().over(within) - 1).join(block.drop("n"), ["old", "size", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("k"))
    # shards of both layouts are bounded, and so are the segments: each ends an old shard's rows or fills a new shard
    placed = ranked.join(F.broadcast(plan), (F.col("old") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows" if capacities is None else "capacity").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
        (F.col("old") != F.col("shard")).alias("moved"),
        *(["row"] if carry else []),
    )


def _layout(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The latest version, and for each shard the version whose folder holds it; 0 and none where nothing was written."""
    try:
        table = spark.read.parquet(f"{path}/layouts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    last = table.agg(F.max("version")).first()[0]
    # one row for each shard, at most MOST_SHARDS
    return last, {r["shard"]: r["held"] for r in table.where(F.col("version") == last).collect()}


def rewrite_shards(assigned: DataFrame, path: str) -> list[int]:
    """Writes the shards whose rows changed and returns their numbers; the others keep their files.

    assigned: reshard with carry=True, so each row is written where it was placed, whatever its id.
    Every call writes into a folder of its own, then a layout that says which folder holds each shard:
    nothing is deleted or overwritten, so a lost job leaves the former layout whole. The first call
    writes all shards. Columns shard and slot of the rows are replaced. read_shards reads it back.
    """
    spark = assigned.sparkSession
    version, layout = _layout(spark, path)
    version += 1
    given = assigned.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = {r["shard"] for r in given.limit(2 * MOST_SHARDS).collect()}
    there = {r["shard"] for r in assigned.select("shard").distinct().limit(2 * MOST_SHARDS).collect()}
    affected = affected | set(layout) - there if layout else there
    if not affected:
        return []
    keep = [f"row.`{c}`" for c in assigned.schema["row"].dataType.names if c.lower() not in ("shard", "slot")]
    rows = assigned.where(F.col("shard").isin(sorted(affected))).select(*keep, "shard", "slot")
    rows = rows.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(f"{path}/files/version={version}")
    layout = {k: v for k, v in layout.items() if k not in affected} | dict.fromkeys(affected & there, version)
    table = spark.createDataFrame(sorted(layout.items()), "shard int, held int")
    table.coalesce(1).write.parquet(f"{path}/layouts/version={version}")
    return sorted(affected)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest layout, with shard and slot."""
    version, layout = _layout(spark, path)
    if not layout:
        raise ValueError(f"no shards in {path}")
    folders = [f"{path}/files/version={v}/shard={k}" for k, v in sorted(layout.items())]
    return spark.read.option("basePath", f"{path}/files").parquet(*folders).drop("version")


def by_source(source: str = "source", old_shards: int = 32) -> F.Column:
    """The old layout of the query: a shard for each hash of the source; a null source is the empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")), F.lit(old_shards))
