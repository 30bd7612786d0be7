"""What the operators share: written tables, text as byte arrays, shingles, groups in blocks.

Text is handled as UTF-8 bytes in NumPy arrays, a few MB at a time, so memory does not follow the
length of a partition. A null text counts as empty everywhere.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.lineage import Written, checkpoint, checkpoint_folder, release
from freshet.operators.network import components as connected_components

__all__ = ["Written", "checkpoint", "checkpoint_folder", "connected_components", "release"]

SLICE_BYTES = 4 << 20
_U = np.uint64


def text_key(text) -> F.Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


# ---------------------------------------------------------------- text as bytes


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offset of each text (one more than there are texts)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most about `most` bytes of text; a longer text comes alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.cumsum(np.asarray(size, dtype=np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


@functools.cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)


_BASE = _U(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the power 0..n, and the same for its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES // 2)
        inverse = pow(int(_BASE), -1, 2**64)
        for name, base in (("up", int(_BASE)), ("down", inverse)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(29))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACES, fold: np.ndarray | None = None):
    """Start, end and 64-bit hash of each word, and for each text the index of its first word.

    gap: by byte value, whether it separates words; fold: by byte value, the value that is hashed.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U), np.zeros(len(offs), np.int64)
    space = gap[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    value = _byte_values() if fold is None else _byte_values()[fold]
    up, down = _power(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(value[data] * up[:n], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offs)


def word_heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], fold: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the numbers of the words that are longer, in bytes, and hashes of their first bytes."""
    value = _byte_values() if fold is None else _byte_values()[fold]
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(value[data] * up[: len(data)], out=total[1:])
    out = []
    for k in sizes:
        longer = np.flatnonzero(ends - starts > k)
        at = starts[longer]
        out.append((longer, mix((total[at + k] - total[at]) * down[at] * _U(2 * k + 1))))
    return out


_STEP = _U(0xD6E8FEB86659FD93)


def word_runs(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, their first word, and the offset of each text's runs.

    A text of 1 to n-1 words has the single run of all its words; an empty one has none.
    """
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(size, out=at[1:])
    if not len(h):
        return np.zeros(0, _U), np.zeros(0, np.int64), at
    run = h.copy()
    for k in range(1, n):
        run = run[:-1] * _STEP + h[k:] if len(run) > 1 else run[:0]
    begin = np.repeat(first[:-1] - at[:-1], size) + np.arange(at[-1])
    out = np.zeros(at[-1], _U)
    full = np.repeat(count >= n, size)
    out[full] = run[begin[full]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        value = 0
        for x in h[first[i] : first[i + 1]].tolist():
            value = (value * int(_STEP) + x) % 2**64
        out[at[i]] = value ^ int(count[i])
    return mix(out), begin, at


# ---------------------------------------------------------------- groups of rows, in order


def grouped(df: DataFrame, keys: list[str], work: Callable, schema: str, order: list[str] = (), parts: int | None = None) -> DataFrame:
    """work(table) -> record batch or None for each group of `keys`, as a sorted scan of each partition.

    Like applyInArrow, with far less cost for each small group. Only for groups of bounded size.
    """
    cols = df.columns
    target = pa_schema(df.sparkSession, schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.zeros(batch.num_rows + 1, bool)
            for k in keys:
                col = batch.column(cols.index(k))
                cuts[1:-1] |= np.asarray(pc.fill_null(pc.not_equal(col[1:], col[:-1]), True), dtype=bool) if batch.num_rows > 1 else False
            edges = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                piece = batch.slice(lo, hi - lo)
                if lo == 0 and held and any(held[0].column(cols.index(k))[0] != piece.column(cols.index(k))[0] for k in keys):
                    out.append(work(pa.Table.from_batches(held)))
                    held = []
                if lo == 0:
                    held.append(piece)
                else:
                    out.append(work(pa.Table.from_batches(held)))
                    held = [piece]
            out = [x for x in out if x]
            if sum(len(next(iter(x.values()))) for x in out) > 20_000:
                yield from (pa.RecordBatch.from_pydict(x, schema=target) for x in out)
                out = []
        if held:
            out.append(work(pa.Table.from_batches(held)))
        yield from (pa.RecordBatch.from_pydict(x, schema=target) for x in out if x)

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)


def pa_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# ---------------------------------------------------------------- all pairs of a group, in blocks


def in_blocks(members: DataFrame, size: F.Column, block_rows: int, block_bytes: int) -> DataFrame:
    """members (grp, ...) with nb, the number of blocks of its group. size: bytes that a member brings."""
    whole = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum(size).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("m") / block_rows, F.col("bytes") / block_bytes)).cast("int")
    return members.join(whole.where("m > 1").select("grp", F.greatest(blocks, F.lit(1)).alias("nb")), "grp")


def linked_groups(members: DataFrame, kernel: Callable, counted: bool = True) -> DataFrame:
    """Compares all members of each group: (a, b, texts, rows); b is null in rows that count links.

    members: key long, grp, nb int (blocks of the group), n long (how many rows the key stands for),
    payload binary. kernel(list of payloads, list or None) -> boolean matrix of links (None: with itself).
    A group of any size is dealt in blocks, and each pair of blocks is one unit of work; what leaves a
    unit is a count for each member (if counted) and the edges of a spanning forest, never its pairs.
    In a group of one block the edges are stars about the smallest key of each component.
    """
    dealt = members.withColumn("block", F.expr("cast(pmod(xxhash64(key), nb) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    dealt = dealt.select(
        "grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "key", "n", "payload"
    )

    def work(t: pa.Table):
        if t.num_rows < 2:
            return None
        bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
        block, keys, n, payload = np.asarray(t["block"]), np.asarray(t["key"]), np.asarray(t["n"]), t["payload"].to_pylist()
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        if not len(left) or not len(right):
            return None
        if bi == bj:
            m = kernel(payload, None)
            np.fill_diagonal(m, False)
            node, label = left, _labels(m)
            texts, rows = m.sum(1), (m @ n if counted else None)
        else:
            m = kernel([payload[i] for i in left], [payload[i] for i in right])
            node, label = np.concatenate([left, right]), _cross_labels(m)
            texts = np.concatenate([m.sum(1), m.sum(0)])
            rows = np.concatenate([m @ n[right], n[left] @ m]) if counted else None
        at = np.flatnonzero(texts) if counted else texts[:0]
        tied = np.flatnonzero(label != np.arange(len(label)))
        if not len(at) and not len(tied):
            return None
        zero, none = np.zeros(len(tied), np.int64), pa.nulls(len(at), pa.int64())
        return {
            "a": np.concatenate([keys[node[at]], keys[node[tied]]]),
            "b": pa.concat_arrays([none, pa.array(keys[node[label[tied]]], pa.int64())]),
            "texts": np.concatenate([texts[at], zero]),
            "rows": np.concatenate([rows[at] if counted else at, zero]),
        }

    return grouped(dealt, ["grp", "bi", "bj"], work, "a long, b long, texts long, rows long", ["key"])


def _labels(m: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row of its component."""
    label = np.full(len(m), -1)
    for i in range(len(m)):
        if label[i] < 0:
            seen = np.zeros(len(m), bool)
            seen[i] = True
            edge = seen
            while edge.any():
                edge = m[edge].any(0) & ~seen
                seen |= edge
            label[seen] = i
    return label


def _cross_labels(m: np.ndarray) -> np.ndarray:
    """The same for links between two sides; rows of the first come before those of the second."""
    r, c = m.shape
    label = np.arange(r + c)
    done = np.zeros(r, bool)
    for i in range(r):
        if not done[i]:
            rows, cols = np.zeros(r, bool), np.zeros(c, bool)
            rows[i] = True
            fresh = rows
            while fresh.any():
                new = m[fresh].any(0) & ~cols
                cols |= new
                fresh = m[:, new].any(1) & ~rows
                rows |= fresh
            done |= rows
            label[:r][rows] = label[r:][cols] = i
    return label


def candidate_groups(classes: DataFrame, kernel: Callable, first: int = 4, block_rows: int = 4096) -> DataFrame:
    """(key, grp) for keys that may link with another: components of the pairs that share a band and pass the kernel.

    classes: key long, bands array<bigint> (hashes with the number of the band in them), payload binary.
    The keys of each bucket are compared by their payloads in blocks, whatever their number. The first
    bands come first; of the others only buckets count that still join different components, so the
    members of a large cluster are not sent once for every band.
    """
    found = label = None
    for bands in (F.slice("bands", 1, first), F.expr(f"slice(bands, {first + 1}, greatest(size(bands) - {first}, 0))")):
        have = classes.select("key", "bands") if label is None else classes.select("key", "bands").join(label, "key", "left")
        comp = F.col("key") if label is None else F.coalesce("grp", "key")
        rows = have.select("key", comp.alias("comp"), F.explode(bands).alias("grp"))
        # minima are combined map-side, so a hot bucket never meets in one task
        mixed = rows.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
        members = checkpoint(rows.select("key", "grp").join(mixed, "grp", "left_semi"))
        dealt = in_blocks(members, F.lit(1), block_rows, 1 << 40).join(classes.select("key", "payload"), "key")
        edges = checkpoint(linked_groups(dealt.withColumn("n", F.lit(1).cast("long")), kernel, counted=False))
        found = edges if found is None else found.union(edges)
        label = connected_components(found).select(F.col("node").alias("key"), F.col("component").alias("grp"))
        release(classes)
    return label
