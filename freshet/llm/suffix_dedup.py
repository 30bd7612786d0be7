"""Exact substring dedup: maximal repeats from the interval tree of a sparse enhanced suffix array.

Winnowing (Schleimer et al., 2003) picks anchors by content, at least one in every window of the
wanted length, the same one in every copy of the window. Anchors whose bytes occur twice are
grouped, and each group is a small enhanced suffix array: its suffixes, from the anchor on, come in
sorted order, and a stack scan over their common prefixes walks the tree of intervals. Occurrences
are ordered by their text to the left too, with common lengths of neighbours and their range minima;
in this order it shows how alike the members of an interval extend to the left. A set of occurrences
that differs on both sides is a maximal repeat group. Together the groups hold every repeated window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C

SLICE = 2 << 20
#: Occurrences of an anchor in one block; a more common anchor is compared in pairs of blocks.
GROUP_ROWS = 40_000
#: Occurrences from which an anchor is not dealt by its hash.
COMMON_ROWS = 10_000
_LOW = np.uint64((1 << 24) - 1)


def gram(least: int) -> int:
    """Bytes of an anchor. The longer, the fewer anchors occur twice by chance, and the more there are in all."""
    return max(1, min(128, least * 8 // 25))


def anchors(data: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash) of each anchor of texts that have at least `least` bytes."""
    size_, n = gram(least), len(data)
    width = least - size_ + 1
    size = np.diff(offs)
    none = np.zeros(0, np.int64)
    if n < least or size.max(initial=0) < least:
        return none, none, none.astype(np.uint64)
    up, down = C._power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(C._byte_values()[data] * up[:n], out=total[1:])
    grams = n - size_ + 1
    h = C.mix((total[size_:] - total[:-size_]) * down[:grams])
    del total
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - offs[text]
    # of equal hashes the last one in a window is least
    order = (h & ~_LOW) | (_LOW - (place[:grams].astype(np.uint64) & _LOW))
    room = -(-grams // width) * width
    v = np.full(room, np.iinfo(np.uint64).max, np.uint64)
    v[:grams] = order
    tiles = v.reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.flatnonzero(place[: n - least + 1] + least <= size[text[: n - least + 1]])
    low = np.minimum(back[windows], ahead[windows + width - 1])
    new = np.ones(len(windows), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[windows[1:]] != text[windows[:-1]])
    w, low = windows[new], low[new]
    at = place[w].astype(np.uint64)
    place_of = (at + (((_LOW - (low & _LOW)) - at) & _LOW)).astype(np.int64)
    # a window's anchor can change and change back to the same place only across texts
    return text[w], place_of, h[offs[text[w]] + place_of]


def _anchor_scan(least: int):
    def work(batches):
        for batch in C.slices(batches, most=SLICE):
            data, offs = C.utf8(batch.column(1))
            text, place, h = anchors(data, offs, least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(place, pa.int32()), pa.array(h.view(np.int64))], ["key", "pos", "hash"])

    return work


def _context_scan(least: int, fold: bool):
    """For each anchor of a text, the bytes before it (backwards) and from it on, as far as a window goes.

    fold: surroundings that a text has twice give their stretches at once, and one member of the group.
    """
    reach = least - gram(least)

    def work(batches):
        for batch in C.slices(batches, most=SLICE):
            data, offs = C.utf8(batch.column(1))
            raw = data.tobytes()
            out: list[tuple] = []
            for i, (key, marks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lo, hi = int(offs[i]), int(offs[i + 1])
                seen: dict[tuple, int] = {}
                own: list[tuple[int, int]] = []
                for m in marks:
                    p = lo + m["pos"]
                    left = raw[max(lo, p - reach) : p][::-1]
                    right = raw[p : min(hi, p + least)]
                    first = seen.get((m["hash"], left, right))
                    if fold and first is not None and len(left) + len(right) >= least:
                        # the same surroundings twice in a text: both are covered as far as they go
                        own += [(q - lo - len(left), q - lo + len(right)) for q in (first, p)]
                        continue
                    seen[m["hash"], left, right] = p
                    nb = m["nb"]
                    block = (p - lo + key[0] * 256 + key[1]) % nb
                    for other in range(nb):
                        out.append((m["hash"], min(block, other), max(block, other), key, p - lo, left, right, None, None))
                # dealt by the text, as they need to meet no other
                spread = int.from_bytes(key[:8], "big", signed=True)
                out += [(spread, -1, -1, key, 0, None, None, a, b) for a, b in _union(own)]
                if len(out) > 2000:
                    yield _contexts(out)
                    out = []
            if out:
                yield _contexts(out)

    return work


_CONTEXT = "hash long, bi int, bj int, key binary, pos int, left binary, right binary, s int, e int"


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _union(stretches: list[tuple[int, int]]) -> list[list[int]]:
    """The stretches in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the intervals of an array of neighbours' common lengths, inner ones first.

    common[i] is between members i - 1 and i; common[0] is not used.
    """
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        now, first = (common[i] if i < len(common) else -1), i - 1
        while stack and stack[-1][0] > now:
            value, first = stack.pop()
            if value > 0:
                yield value, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def _neighbours(texts: list[bytes]) -> list[int]:
    """Common length of each text with the one before it (0 for the first)."""
    if len(texts) < 8:
        return [0] + [_common(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    out = [np.zeros(1, np.int64)]
    for lo in range(0, len(texts) - 1, 4096):
        part = texts[lo : lo + 4097]
        size = np.array([len(x) for x in part])
        width = int(size.max()) + 1
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        apart = grid[1:] != grid[:-1]
        apart[:, -1] = True
        out.append(np.minimum(apart.argmax(1), np.minimum(size[1:], size[:-1])))
    return np.concatenate(out).tolist()


class _Minima:
    """Least value of any stretch of a list, from a table of stretches of powers of two."""

    def __init__(self, values: list[int]):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]).tolist())
            step *= 2

    def __call__(self, lo: int, hi: int) -> int:
        k = (hi - lo).bit_length() - 1
        row = self.rows[k]
        a, b = row[lo], row[hi - (1 << k)]
        return a if a < b else b


class Contexts:
    """The suffixes of a group in order, with common lengths on both sides. right must be sorted."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.ahead = _neighbours(right)
        self.order = sorted(range(len(left)), key=left.__getitem__)
        self.rank = [0] * len(left)
        for k, i in enumerate(self.order):
            self.rank[i] = k
        self.behind = _Minima(_neighbours([left[i] for i in self.order]))

    def alike(self, p: int, q: int) -> int:
        """Common length to the left of the members of ranks p < q."""
        return self.behind(p + 1, q + 1)


def longest_stretches(left: list[bytes], right: list[bytes], least: int) -> tuple[list[int], list[int]]:
    """How far the repeats of at least `least` bytes reach from each member to the left and to the right (-1: none).

    The stack scan closes intervals from the inside out. Where two of them join, only members that
    become neighbours in the order of the text to the left can extend further than before, since of all
    members it is a neighbour that has most in common; the smaller part is put into the larger one.
    """
    m = len(right)
    s, e = [-1] * m, [-1] * m
    c = Contexts(left, right)
    order, ahead, alike = c.order, c.ahead, c.alike

    def meet(p: int, q: int, value: int) -> None:
        length = alike(p, q)
        if length + value >= least:
            for i in (order[p], order[q]):
                if s[i] < length:
                    s[i] = length
                if e[i] < value:
                    e[i] = value

    stack: list[tuple[int, list[int]]] = []
    for i in range(1, m + 1):
        now = ahead[i] if i < m else -1
        members = [c.rank[i - 1]]
        while stack and stack[-1][0] >= now:
            value, other = stack.pop()
            if len(other) < len(members):
                other, members = members, other
            for r in members:
                at = bisect_left(other, r)
                if at:
                    meet(other[at - 1], r, value)
                if at < len(other):
                    meet(r, other[at], value)
                other.insert(at, r)
            members = other
        stack.append((now, members))
    return s, e


def repeat_groups(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of maximal repeats of at least `least` bytes.

    right must be sorted. A group is reported where its members part both to the right (they lie in
    different children of the interval) and to the left (they are all that share that much).
    """
    m = len(right)
    c = Contexts(left, right)
    ahead = c.ahead
    reach = max(map(len, left))
    for value, first, last in _intervals(ahead):
        if value + reach < least:
            continue
        child, k = {}, 0
        for i in range(first, last + 1):
            k += i > first and ahead[i] == value
            child[i] = k
        ranks = np.sort(np.array(c.rank[first : last + 1]))
        by = [c.order[r] for r in ranks.tolist()]
        behind = [0] + [c.alike(p, q) for p, q in zip(ranks.tolist(), ranks[1:].tolist(), strict=False)]
        inner = list(_intervals(behind))
        if value >= least and not (inner and inner[-1][1:] == (0, len(by) - 1)):
            inner.append((0, 0, len(by) - 1))
        for length, lo, hi in inner:
            if length + value < least:
                continue
            group = by[lo : hi + 1]
            if any(child[i] != child[group[0]] for i in group):
                yield length, value, group


def _cover(least: int):
    """A group of contexts to the stretch of each occurrence that its repeats cover."""

    def work(t: pa.Table):
        key, pos = t["key"].to_pylist(), t["pos"].to_pylist()
        left, right = t["left"].to_pylist(), t["right"].to_pylist()
        out = [(key[i], s, e) for i, (s, e) in enumerate(zip(t["s"].to_pylist(), t["e"].to_pylist(), strict=True)) if s is not None]
        use = [i for i, r in enumerate(right) if r is not None]
        if len(use) > 1:
            s, e = longest_stretches([left[i] for i in use], [right[i] for i in use], least)
            # every stretch holds the anchor, so their union is one stretch
            out += [(key[i], pos[i] - s[k], pos[i] + e[k]) for k, i in enumerate(use) if e[k] >= 0]
        return dict(zip(("key", "s", "e"), map(list, zip(*out, strict=True)), strict=True)) if out else None

    return work


def _repeats(least: int):
    def work(t: pa.Table):
        key, pos = t["key"].to_pylist(), t["pos"].to_pylist()
        left, right = t["left"].to_pylist(), t["right"].to_pylist()
        out = []
        for before, after, group in repeat_groups(left, right, least) if len(left) > 1 else ():
            name = hashlib.sha256(left[group[0]][:before][::-1] + right[group[0]][:after]).hexdigest()
            out += [(name, before + after, key[i], pos[i] - before) for i in group]
        return dict(zip(("repeat", "length", "key", "start"), map(list, zip(*out, strict=True)), strict=True)) if out else None

    return work


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), C.text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def _anchors(base: DataFrame, least: int) -> C.Written:
    return C.Written(base.select("key", "text").mapInArrow(_anchor_scan(least), "key binary, pos int, hash long"))


def _repeated(found: DataFrame) -> DataFrame:
    """The anchors whose hash occurs at two places or in two texts, with m, the number of its occurrences.

    Counts are combined map-side. Common anchors are few, at most one for each COMMON_ROWS rows: they
    are broadcast and their rows stay in the partition where they lie, so none meets in one task.
    """
    k = F.xxhash64("key")
    seen = found.groupBy("hash").agg(F.min(k).alias("k1"), F.max(k).alias("k2"), F.min("pos").alias("p1"), F.max("pos").alias("p2"), F.count("*").alias("m"))
    seen = seen.where("k1 <> k2 or p1 <> p2").select("hash", "m")
    common = F.broadcast(seen.where(F.col("m") > COMMON_ROWS))
    rare = found.join(common, "hash", "left_anti").join(seen.where(F.col("m") <= COMMON_ROWS), "hash")
    return rare.unionByName(found.join(common, "hash"))


def _grouped_contexts(base: DataFrame, classes: DataFrame, found: DataFrame, least: int, fold: bool = True) -> DataFrame:
    # a very common anchor is compared in pairs of blocks
    mark = F.struct("hash", "pos", F.ceil(F.col("m") / GROUP_ROWS).cast("int").alias("nb"))
    marks = _repeated(found).groupBy("key").agg(F.collect_set(mark).alias("marks")).join(classes.select("key", "id"), "key")
    b, m = base.alias("b"), marks.alias("m")
    texts = b.join(m, F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.key") == F.col("m.key"))).select("b.key", "b.text", "m.marks")
    return texts.mapInArrow(_context_scan(least, fold), _CONTEXT)


def _cut(least: int):
    def work(batches):
        for batch in C.slices(batches):
            data, offs = C.utf8(batch.column(1))
            copies, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                if (copies[i] or 1) > 1 and len(raw) >= least:
                    gone = [[0, len(raw)]]
                else:
                    gone = _union([(x["s"], x["e"]) for x in spans[i] or ()])
                edges = [0, *(y for x in gone for y in x), len(raw)]
                kept = hashlib.sha256()
                for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                    kept.update(raw[lo:hi])
                rows.append((len(raw), sum(e - s for s, e in gone), len(gone), kept.hexdigest(), [{"s": s, "e": e} for s, e in gone]))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of byte spans).

    Every byte is removed that lies in a string of `least` bytes which also starts anywhere else, in
    this document or another, overlaps included; strings are those of the input. Null and empty texts
    have no bytes. Equal rows are copies of each other, so all their bytes go if they have `least`.
    Rows without an id are documents like others.
    """
    kind = dict(docs.dtypes)[id_col]
    base = _keyed(docs, id_col, text_col)
    classes = C.checkpoint(base.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    found = _anchors(base, least)
    contexts = _grouped_contexts(base, classes, found.table, least)
    covered = C.grouped(contexts, ["hash", "bi", "bj"], _cover(least), "key binary, s int, e int", ["right"])
    spans = C.checkpoint(covered.distinct().groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    found.drop()
    C.release(spans)
    marks = classes.select("key", "n").join(spans, "key", "left").where("n > 1 or spans is not null")
    out = base.join(marks, "key", "left").select("id", "text", "n", "spans")
    out = out.mapInArrow(_cut(least), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<s:int,e:int>>")
    return out.withColumnRenamed("id", id_col)


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400) -> DataFrame:
    """Maximal repeat groups: (repeat, length, id, start), a row for each occurrence, copies of texts included.

    repeat is the SHA-256 of the repeated bytes. Repeats are followed as far as they can be seen from
    an anchor, `least` bytes to the right and `least` - gram(least) to the left, so longer ones come as overlapping
    groups; a text that several rows have is a group as a whole too. Null and shorter texts have none.
    Equal rows (same id and text) are occurrences of their own.
    """
    base = _keyed(docs, id_col, text_col)
    classes = C.checkpoint(base.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    marks = _anchors(base, least)
    contexts = _grouped_contexts(base, classes, marks.table, least, fold=False)
    found = C.checkpoint(C.grouped(contexts, ["hash", "bi", "bj"], _repeats(least), "repeat string, length int, key binary, start int", ["right"]).distinct())
    marks.drop()
    found = base.select("id", "key").join(found, "key").select("repeat", "length", "id", "start")
    copies = base.join(classes.where("n > 1").select("key"), "key", "left_semi").where(F.octet_length("text") >= least)
    whole = copies.select(F.sha2(F.col("text").cast("binary"), 256).alias("repeat"), F.octet_length("text").alias("length"), "id", F.lit(0).alias("start"))
    return found.union(whole).withColumnRenamed("id", id_col)
