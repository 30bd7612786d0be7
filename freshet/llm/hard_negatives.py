"""Hard negatives by inverted lists of k-means with stored radii, exact.

Every row lies in the list of its nearest centroid, with the largest distance of a member beside it. By
Cauchy-Schwarz a list's scores for a query lie within |query| x radius of the centroid's. Lists are
visited from the highest upper bound down, a growing number at a time; lists outside a query's window are
skipped, and a query is done when the bound of what is left is strictly below its k-th score, as an equal
score with a smaller id could still come first. Vectors are whole numbers, so scores are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm import common as C

SAMPLE_ROWS = 20_000
LIST_ROWS = 512
MOST_LISTS = 1024
BLOCK_ROWS = 8192
FIRST_LISTS, GROWTH = 8, 4
VISITS = 4096
_FAR = 1 << 62
_VECTOR = "row long, id long, label long, dim int, payload binary"


def _packed(dtype: str, width: int):
    """Vectors as bytes of one type and width, zeros behind those that are shorter."""

    def work(batches):
        for b in batches:
            size = np.diff(np.asarray(b.column(3).offsets))
            m = np.zeros((b.num_rows, width), dtype)
            m[np.arange(width)[None, :] < size[:, None]] = np.asarray(b.column(3).flatten()).astype(dtype)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(size, pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], ["row", "id", "label", "dim", "payload"])

    return work


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact: in double precision where that holds them, else as integers of any size."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return (np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b).T).astype(np.int64)


def _matrix(payloads: list[bytes], dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), dtype).reshape(len(payloads), width).astype(np.float64)


def bounds(x: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that a row of each list can score with each query, rounding errors on the safe side."""
    mid, size = x @ centroids.T, np.sqrt((x * x).sum(1))[:, None]
    reach = size * radius[None, :]
    slack = 1e-9 * (reach + size * np.sqrt((centroids**2).sum(1))[None, :]) + 1e-6
    return mid - reach - slack, mid + reach + slack


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds from distinct rows of it; a list that runs empty keeps its centroid."""
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(seed).permutation(len(start))[:lists]].copy()
    for _ in range(rounds):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        by = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[by], np.arange(len(c) + 1))
        full = np.flatnonzero(np.diff(edge))
        c[full] = np.add.reduceat(x[by], edge[full]) / np.diff(edge)[full][:, None]
    return c


class Lists:
    """The index: blocks of at most BLOCK_ROWS rows, each of one list; centroids and radii of the lists."""

    def __init__(self, points: DataFrame, dtype: str, width: int, sample_rows: int = SAMPLE_ROWS):
        """points: (row, id, label, dim, payload). Centroids come from at most sample_rows of them, every row is listed."""
        self.dtype, self.width = dtype, width
        count = points.count()
        sample = points.select("payload").orderBy(F.xxhash64("row"), "row").limit(sample_rows).toArrow()["payload"].to_pylist()
        centroids = kmeans(_matrix(sample, dtype, width), min(MOST_LISTS, max(1, count // LIST_ROWS))) if sample else np.zeros((0, width))

        def assign(batches):
            for b in C.slices(batches, "payload", 1 << 20):
                x = _matrix(b.column(4).to_pylist(), dtype, width)
                own = np.argmin((centroids * centroids).sum(1) - 2 * x @ centroids.T, axis=1)
                far = np.sqrt(((x - centroids[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(far)], [*b.schema.names, "list", "far"])

        placed = C.Written(points.mapInArrow(assign, f"{_VECTOR}, list int, far double"))
        # rows of a list side by side, whatever its size: sorted by range, not by list
        runs = placed.table.repartitionByRange("list", "far", "row").sortWithinPartitions("list", "far", "row").withColumn("part", F.spark_partition_id())

        def pack(batches):
            held, seq = [], 0

            def block(t: pa.Table):
                nonlocal seq
                seq += 1
                one = lambda c: pa.array([t[c].to_pylist()])
                return pa.RecordBatch.from_arrays(
                    [t["list"].combine_chunks()[:1], pa.array([t["part"][0].as_py() * 2**32 + seq], pa.int64()), *[one(c).cast(pa.list_(pa.int64())) for c in ("row", "id", "label", "dim")], pa.array([b"".join(t["payload"].to_pylist())], pa.binary()), pa.array([max(t["far"].to_pylist())])],
                    ["list", "block", "row", "id", "label", "dim", "payload", "far"],
                )

            for b in batches:
                names = np.asarray(b.column(5))
                edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    while lo < hi:
                        if held and held[0].column(5)[0] != b.column(5)[lo]:
                            yield block(pa.Table.from_batches(held))
                            held = []
                        room = BLOCK_ROWS - sum(h.num_rows for h in held)
                        held.append(b.slice(lo, min(room, hi - lo)))
                        lo += held[-1].num_rows
                        if held[-1].num_rows == room:
                            yield block(pa.Table.from_batches(held))
                            held = []
            if held:
                yield block(pa.Table.from_batches(held))

        schema = "list int, block long, row array<bigint>, id array<bigint>, label array<bigint>, dim array<bigint>, payload binary, far double"
        self.blocks = C.Written(runs.mapInArrow(pack, schema))
        placed.drop()
        radius = np.full(len(centroids), -np.inf)  # a row for each list
        for r in self.blocks.table.groupBy("list").agg(F.max("far").alias("far")).collect():
            radius[r["list"]] = r["far"]
        self.centroids, self.radius = centroids[radius >= 0], radius[radius >= 0]
        self.names = np.flatnonzero(radius >= 0)


def _choose(lists: Lists, first: int, last: int):
    """(q, list, ...) of the visits of each query to its lists from the first-th to the last-th by upper bound."""
    dtype, width, centroids, radius, names = lists.dtype, lists.width, lists.centroids, lists.radius, lists.names

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                low, high = bounds(_matrix(b.column(3).to_pylist(), dtype, width), centroids, radius)
                order = np.argsort(-high, axis=1, kind="stable")[:, first:last]
                at, to = [], []
                for i, wins in enumerate(b.column(4).to_pylist()):
                    up, down = high[i, order[i]], low[i, order[i]]
                    open_ = np.zeros(order.shape[1], bool)
                    for w in wins:
                        open_ |= (up >= max(w["lo"], w["kth"])) & (down <= w["hi"])
                    hit = order[i][open_]
                    at += [i] * len(hit)
                    to += names[hit].tolist()
                took = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(to, pa.int32())], [*b.schema.names, "list"])

    return work


def _visit(dtype: str, width: int, same: bool, k: int):
    """The first k rows of a block in each window of the queries that visit it, a block's row coming before its visits."""

    def work(batches):
        block = None
        for batch in batches:
            kind = np.asarray(batch.column(2))
            edges = sorted({0, batch.num_rows, *np.flatnonzero(kind == 0).tolist(), *(np.flatnonzero(kind == 0) + 1).tolist()})
            for start, end in zip(edges, edges[1:], strict=False):
                if kind[start] == 0:
                    one = batch.slice(start, 1)
                    held = [one.column(i)[0].values for i in range(8, 12)]
                    lists, null = [np.asarray(x.fill_null(_FAR)) for x in held], np.asarray(held[1].is_null())
                    block = (*lists, null, np.frombuffer(one.column(6)[0].as_py(), dtype).reshape(-1, width))
                    continue
                row, ids, labels, dims, null, m = block
                for lo in range(start, end, 256):
                    b = batch.slice(lo, min(256, end - lo))
                    x = np.frombuffer(b"".join(b.column(6).to_pylist()), dtype).reshape(-1, width)
                    s = dots(x, m)
                    fits = (np.asarray(b.column(4))[:, None] == labels[None, :]) == same
                    fits &= np.asarray(b.column(5))[:, None] == dims[None, :]
                    out: list[tuple] = []
                    for i, (q, wins) in enumerate(zip(b.column(3).to_pylist(), b.column(7).to_pylist(), strict=True)):
                        near = np.flatnonzero(fits[i])
                        score = s[i, near]
                        for w in wins:
                            hit = np.flatnonzero((score >= max(w["lo"], w["kth"])) & (score <= w["hi"]))
                            if len(hit) > k:
                                least = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                                hit = hit[score[hit] >= least]  # with all that tie with the last
                            at = near[hit]
                            at = at[np.lexsort((row[at], ids[at], -s[i, at]))[:k]]
                            out += [(q, w["w"], r, None if o else d, v) for r, d, o, v in zip(row[at].tolist(), ids[at].tolist(), null[at].tolist(), s[i, at].tolist(), strict=True)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["q", "w", "row", "id", "score"])

    return work


def search(lists: Lists, queries: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, w, rank, row, id, score): the first k rows in each window of each query, by falling score, then by id, nulls last.

    queries: (q, label, dim, payload); windows: (q, w, lo, hi), few for each query. same: rows of the
    query's label, else rows of all others. Only rows of the query's dimension count.
    """
    best = None
    win = "array<struct<w:bigint,lo:bigint,hi:bigint,kth:bigint>>"
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    first, last = 0, FIRST_LISTS
    while first < max(1, len(lists.names)):
        kth = F.lit(-_FAR)
        state = windows
        if best is not None:
            full = best.table.where(F.col("rank") == k).select("q", "w", F.col("score").alias("_kth"))
            state, kth = windows.join(full, ["q", "w"], "left"), F.coalesce("_kth", F.lit(-_FAR))
        state = state.groupBy("q").agg(F.collect_list(F.struct("w", "lo", "hi", kth.cast("long").alias("kth"))).alias("wins"))
        open_ = queries.join(state, "q").select("q", "label", "dim", "payload", "wins")
        visits = C.Written(open_.mapInArrow(_choose(lists, first, last), f"q long, label long, dim int, payload binary, wins {win}, list int"))
        # a list that many queries visit is dealt in as many pieces as keep their number bounded
        pieces = visits.table.groupBy("list").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("pieces"))
        # a row for each list or block is sent out; never the visits, whose files are far smaller than their rows
        blocks = lists.blocks.table.join(F.broadcast(pieces), "list")
        none = F.lit(None)
        held = blocks.select("block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), none.cast("long").alias("q"), none.cast("long").alias("label"), none.cast("int").alias("dim"), "payload", none.cast(win).alias("wins"), "row", F.col("id").alias("ids"), F.col("label").alias("labels"), F.col("dim").alias("dims"))
        asks = visits.table.join(F.broadcast(blocks.select("list", "block", "pieces")), "list")
        asks = asks.select("block", F.pmod(F.xxhash64("q"), F.col("pieces")).cast("int").alias("piece"), F.lit(1).alias("kind"), "q", "label", "dim", "payload", "wins", *[none.cast("array<bigint>").alias(c) for c in ("row", "ids", "labels", "dims")])
        met = held.union(asks).repartition("block", "piece").sortWithinPartitions("block", "piece", "kind")
        found = met.mapInArrow(_visit(lists.dtype, lists.width, same, k), "q long, w long, row long, id long, score long")
        if best is not None:
            found = found.union(best.table.drop("rank"))
        merged = C.Written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        visits.drop()
        if best is not None:
            best.drop()
        best = merged
        first, last = last, last + (last - first) * GROWTH
    return best.table.select("q", "w", "rank", "row", "id", "score")


def hard_negatives(
    table: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where `anchor` holds.

    A component x counts as floor(scale * x). An anchor's positives are its first `positives` other rows of
    its label; for each the first `negatives` rows of other labels whose score is between low and high
    percent of the positive's. Ids and labels are whole numbers (other labels go by a hash), components
    below 2^63 / scale. Rows with a null label, a null vector or a part that is null or not finite take
    no part; vectors of different length are never compared. Null ids come last among ties; repeated rows
    are rows of their own, with one id or not. A positive with nothing in its window, as every one with a
    score below 0, has no rows. Of rows with equal vector and label only the first by id can be returned,
    so no more than that are listed. Other columns are not read; an empty table gives no rows.
    """
    types = dict(table.dtypes)
    whole = types[label_col] in ("tinyint", "smallint", "int", "bigint")
    vec = F.col(vec_col).cast("array<double>")
    known = F.col(label_col).isNotNull() & vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    label = F.col(label_col).cast("long") if whole else F.xxhash64(F.col(label_col).cast("string"))
    base = table.where(known).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(vec, lambda x: F.floor(x * scale).cast("double")).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = C.Written(base)
    shape = base.table.agg(F.max(F.size("vec")).alias("width"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if shape["width"] is None:
        return table.sparkSession.createDataFrame([], out)
    width, most = max(1, shape["width"]), shape["most"] or 0
    dtype = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    packed = lambda t: t.select("row", "id", "label", "vec").mapInArrow(_packed(dtype, width), _VECTOR)
    keep = max(positives + 1, negatives)
    copies = Window.partitionBy("label", "dim", "payload").orderBy(F.asc_nulls_last("id"), "row")
    points = C.Written(packed(base.table).withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= keep).drop("_n"))
    lists = Lists(points.table, dtype, width, sample_rows)
    own = C.Written(packed(base.table.where("anchor")))
    asked = C.Written(own.table.select("label", "dim", "payload").distinct().withColumn("q", F.monotonically_increasing_id()))
    anchors = own.table.join(asked.table, ["label", "dim", "payload"]).select(F.col("row").alias("_own"), F.col("id").alias("anchor_id"), "q")
    all_ = asked.table.select("q", F.lit(0).cast("long").alias("w"), F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))
    near = search(lists, asked.table, all_, positives + 1, True)
    # the anchor itself may be among the first of its own label
    other = anchors.join(near.withColumnsRenamed({"row": "_row", "id": "positive_id", "score": "positive_score"}), "q").where("_row <> _own")
    place = F.row_number().over(Window.partitionBy("_own").orderBy("rank"))
    pairs = C.Written(other.withColumn("_p", place).where(F.col("_p") <= positives).select("q", "anchor_id", "positive_id", "positive_score"))
    score = F.col("positive_score")
    # whole multiples of a hundredth, by integers: -((-a) div b) is the quotient rounded up
    spans = pairs.table.where(score >= 0).select("q", score.alias("w")).distinct().select("q", "w", F.expr(f"-floor(cast(-{low} * cast(w as decimal(38,0)) / 100 as decimal(38,2)))").cast("long").alias("lo"), F.expr(f"floor(cast({high} * cast(w as decimal(38,0)) / 100 as decimal(38,2)))").cast("long").alias("hi"))
    spans = C.Written(spans)
    far = search(lists, asked.table, spans.table, negatives, False)
    found = pairs.table.join(far.select("q", F.col("w").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["q", "positive_score"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
