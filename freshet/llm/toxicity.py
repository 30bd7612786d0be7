"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its words, pairs and triples of neighbours, pairs that skip one or two words, and
the beginnings of its words (which inflected and compounded forms share), each a 64-bit hash. Every coordinate has its own rate, which falls with the gradients it has seen, and an
L1 bound that leaves few weights (McMahan et al., 2013); those are sent to all tasks. Labelled rows are
dealt to shards that learn one after the other row, and after each round the shards' states are averaged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C
from freshet.llm.quality import held_out

SAMPLE_ROWS = 8_000
SHARD_ROWS = 2_000
LEAST_ROWS = 4
ROUNDS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Words of a gram after the first, by their distance from it.
GRAMS = ((), (1,), (1, 2), (2,), (3,))
#: Bytes of a longer word that count as its beginning.
HEADS = (4, 5, 6, 7, 8)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By byte value: whether it parts words (any ASCII byte but letters, digits and '), and its lower case."""
    gap, fold = np.ones(256, bool), np.arange(256)
    gap[128:] = False
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789'ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        gap[c] = False
    fold[ord("A") : ord("Z") + 1] += 32
    return gap, fold


_GAP, _FOLD = _letters()


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the text and 64-bit hash of every gram, repeats included, and how many texts there are."""
    data, offs = C.utf8(texts)
    starts, ends, h, first = C.words(data, offs, _GAP, _FOLD)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    at, out = [], []
    for longer, head in C.word_heads(data, starts, ends, HEADS, _FOLD) if len(h) else ():
        at.append(text[longer])
        out.append(head)
    for k, steps in enumerate(GRAMS):
        far = steps[-1] if steps else 0
        n = len(h) - far
        if n <= 0:
            continue
        value = h[:n] * _STEP + _U(k)
        for s in steps:
            value = C.mix(value) * _STEP + h[s : s + n]
        same = text[:n] == text[far:]
        at.append(text[:n][same])
        out.append(C.mix(value[same]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), len(offs) - 1
    return np.concatenate(at), np.concatenate(out), len(offs) - 1


def _sets(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats inside a text, ordered by text and hash."""
    by = np.lexsort((h, at))
    at, h = at[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return at[new], h[new]


def _gram_counts(batches):
    """Hashes and in how many texts of a slice they occur."""
    for b in C.slices(batches):
        at, h, _ = grams(b.column(b.schema.get_field_index("text")))
        value, n = np.unique(_sets(at, h)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["gram", "n"])


def known_grams(known: np.ndarray, texts: pa.Array) -> pa.ListArray:
    """For each text the places in `known` (sorted hashes) of its grams, ascending."""
    at, h, n = grams(texts)
    place = np.searchsorted(known, h) if len(known) else np.zeros(len(h), np.int64)
    hit = (known[np.minimum(place, len(known) - 1)] == h) if len(known) else np.zeros(len(h), bool)
    at, place = _sets(at[hit], place[hit])
    offs = np.searchsorted(at, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(place, pa.int32()))


def weights(z: np.ndarray, n: np.ndarray, free: bool = False) -> np.ndarray:
    """Weights of a state; a free coordinate (the intercept) has no L1 bound."""
    l1 = 0.0 if free else L1
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn_row(z: np.ndarray, n: np.ndarray, own: np.ndarray, y: int) -> None:
    """One FTRL step on the coordinates of a text; the last coordinate is the intercept and in every text."""
    own = np.append(own, len(z) - 1)
    zi, ni = z[own], n[own]
    w = weights(zi, ni)
    w[-1] = weights(zi[-1], ni[-1], True)
    g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - y
    root = np.sqrt(ni + g * g)
    z[own] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
    n[own] = ni + g * g


def _round(z0: np.ndarray, n0: np.ndarray, most: int):
    """Each shard's state after its rows, from one common state; a shard learns from at most `most` rows."""

    def work(batches):
        shard, z, n, seen = None, None, None, 0

        def state():
            moved = np.flatnonzero(n != n0).astype(np.int32)
            return pa.RecordBatch.from_pydict({"at": [moved.tobytes()], "z": [z[moved].tobytes()], "n": [n[moved].tobytes()]}, schema=pa.schema([(c, pa.binary()) for c in ("at", "z", "n")]))

        for b in batches:
            for s, y, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if s != shard:
                    if shard is not None:
                        yield state()
                    shard, z, n, seen = s, z0.copy(), n0.copy(), 0
                if seen < most:
                    learn_row(z, n, np.asarray(own.values), y)
                seen += 1
        if shard is not None:
            yield state()

    return work


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes (sorted), their weights, none 0, and the intercept, from labelled rows that aren't held out.

    At most sample_rows labels count, taken by a hash of the id, and as many rows of them; a gram counts
    if LEAST_ROWS of those rows hold it. Without labels, or with labels of one kind only, there are no
    weights, and the score of every text is that share: 0.5, 0 or 1.
    """
    ok = F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    known = labels.where(ok).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    # bounded by sample_rows, so small enough to send to every executor
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    sample = C.Written(rows.select(F.xxhash64("id").alias("place"), F.col("id").cast("string").alias("id"), "y", F.md5("text").alias("m"), "text"))
    count = sample.table.agg(F.count("*").alias("rows"), F.coalesce(F.avg("y"), F.lit(0.5)).alias("share")).first()
    if not 0 < count["share"] < 1 or not count["rows"]:
        sample.drop()
        return np.zeros(0, _U), np.zeros(0), {0.0: -math.inf, 1.0: math.inf}.get(count["share"], 0.0)
    shards = math.ceil(min(count["rows"], sample_rows) / SHARD_ROWS)
    each = math.ceil(sample_rows / shards)
    found = sample.table.select("text").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS)
    vocabulary = np.sort(np.asarray(found.select("gram").toArrow()["gram"]).view(_U))

    def placed(batches):
        for b in C.slices(batches):
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], known_grams(vocabulary, b.column(4))], ["shard", "place", "key", "y", "own"])

    keyed = sample.table.select(F.pmod(F.xxhash64("id", "m"), F.lit(shards)).cast("int").alias("shard"), "place", F.concat_ws(" ", "id", "m").alias("key"), "y", "text")
    dealt = keyed.mapInArrow(placed, "shard int, place long, key string, y int, own array<int>")
    # dealt and sorted once: every round reads the rows in the order in which they were checkpointed
    order = C.checkpoint(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "key", "y").select("shard", "y", "own"))
    sample.drop()
    z, n = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    for _ in range(ROUNDS):
        # a state for each shard: at most sample_rows / SHARD_ROWS of them
        states = order.mapInArrow(_round(z, n, each), "at binary, z binary, n binary").toArrow().to_pylist()
        total, hits = np.zeros((2, len(z))), np.zeros(len(z))
        for s in sorted(states, key=lambda s: s["z"]):  # sums don't depend on the order of arrival
            at = np.frombuffer(s["at"], np.int32)
            total[0, at] += np.frombuffer(s["z"])
            total[1, at] += np.frombuffer(s["n"])
            hits[at] += 1
        met = hits > 0
        z[met], n[met] = total[0, met] / hits[met], total[1, met] / hits[met]
    w = weights(z[:-1], n[:-1])
    return vocabulary[w != 0], w[w != 0], float(weights(z[-1:], n[-1:], True)[0])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.5, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= cut).

    Only the text enters a score: null and empty texts, and those without words, have the score of the
    intercept alone; texts of any length are read whole, and equal texts score alike. Rows without an id
    are scored and never learnt from. Null labels and labels of unknown documents are ignored; see fit()
    for tables with too few labels. Repeated rows are rows of their own, and other columns are not read.
    """
    known, w, intercept = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    kind = dict(docs.dtypes)[id_col]
    sieve = np.zeros(1 << 16, bool)
    sieve[(known & _U(0xFFFF)).astype(np.int64)] = True

    def scan(batches):
        for b in C.slices(batches):
            at, h, count = grams(b.column(1))
            near = sieve[(h & _U(0xFFFF)).astype(np.int64)]
            at, h = at[near], h[near]
            place = np.searchsorted(known, h)
            hit = known[np.minimum(place, len(known) - 1)] == h if len(known) else near[:0]
            at, place = _sets(at[hit], place[hit])
            total = intercept + np.bincount(at, w[place], count) if len(at) else np.full(count, intercept)
            with np.errstate(over="ignore"):  # far below 0 the score is 0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-total)))], ["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
