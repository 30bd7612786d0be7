"""N-gram Jaccard self-join with Bayesian candidate pruning (BayesLSH, Satuluri and Parthasarathy, 2012).

Equal texts fold into one class first. Each class has 128 MinHash values over its word runs; bands of
four of them give candidates (a pair at 0.8 is missed with probability below 1e-7). Candidate pairs
compare their MinHash values 32 at a time and go as soon as the posterior probability of reaching the
threshold falls below the tolerance. Components of what is left are verified exactly, all members of
one with each other, on the runs themselves. Buckets and components are compared in blocks, so none
is too large, and pairs never leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C

HASHES, ROWS = 128, 4
STEP = 32
#: Most texts, and bytes of their runs, in a block; pairs of blocks are units of work.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20


def _signature(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, HASHES) least hashes of the runs of each text; zeros where there is none."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, HASHES, dtype=np.uint32)
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((HASHES, len(at) - 1), np.uint32)
    if len(some):
        x = (runs >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            h = (x ^ b[k]) * a[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[k, some] = np.minimum.reduceat(h, at[some])
    return out.T


def _sketch(n: int):
    def work(batches):
        for batch in C.slices(batches):
            data, offs = C.utf8(batch.column(2))
            _, _, h, first = C.words(data, offs)
            runs, _, at = C.word_runs(h, first, n)
            sig = _signature(runs, at)
            bands = np.zeros((len(sig), HASHES // ROWS), np.uint64)
            for r in range(ROWS):
                bands = bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS]
            bands = C.mix(bands * np.uint64(64) + np.arange(HASHES // ROWS, dtype=np.uint64)).view(np.int64)
            some = np.diff(at) > 0
            low = np.ascontiguousarray((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(some * bands.shape[1])]), pa.int32()), pa.array(bands[some].ravel())
            )
            sketch = pa.array([x.tobytes() for x in low], pa.binary())
            size = pa.array(np.diff(at) * 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, sketch, size], ["id", "key", "bands", "sketch", "bytes"])

    return work


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 32, 64 ... equal-or-not comparisons, the fewest matches with which a pair may stay.

    The prior of the similarity is uniform; bytes of MinHash values match by chance once in 256.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) - max(m * math.log(m / n) if m else 0, -700))
            if like[s >= threshold].sum() / max(like.sum(), 1e-300) >= tolerance:
                break
        out.append(m)
    return out


def bayes_kernel(least: list[int]):
    """Whether pairs of sketches stay: the next values are compared for pairs still alive only."""

    def linked(a: list[bytes], b: list[bytes] | None) -> np.ndarray:
        sa, sb = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, HASHES) for x in (a, a if b is None else b))
        out = np.zeros((len(sa), len(sb)), bool)
        for lo in range(0, len(sa), 256):
            rows = sa[lo : lo + 256]
            matches = np.zeros((len(rows), len(sb)), np.uint8)
            for k in range(STEP):
                matches += rows[:, k, None] == sb[None, :, k]
            i, j = np.nonzero(matches >= least[0])
            hits = matches[i, j].astype(np.int64)
            for k, m in enumerate(least[1:], 1):
                part = slice(k * STEP, (k + 1) * STEP)
                for at in range(0, len(i), 1 << 20):
                    s = slice(at, at + (1 << 20))
                    hits[s] += (rows[i[s], part] == sb[j[s], part]).sum(1)
                stay = hits >= m
                i, j, hits = i[stay], j[stay], hits[stay]
            out[lo + i, j] = True
        return out

    return linked


def _runs(n: int):
    """Each text as its sorted distinct runs."""

    def work(batches):
        for batch in C.slices(batches):
            data, offs = C.utf8(batch.column(batch.schema.get_field_index("text")))
            _, _, h, first = C.words(data, offs)
            runs, _, at = C.word_runs(h, first, n)
            sets = [np.unique(runs[at[i] : at[i + 1]]).tobytes() for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sets, pa.binary())], ["key", "grp", "nb", "n", "payload"])

    return work


def jaccard_kernel(threshold: float):
    whole = round(threshold * 1000)

    def linked(a: list[bytes], b: list[bytes] | None) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in [*a, *(b or [])]]
        size = np.array([len(x) for x in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            common = np.array([[both]]) if b is not None else np.array([[size[0], both], [both, size[1]]])
        else:
            row = np.repeat(np.arange(len(sets)), size)
            value, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            rank = np.cumsum(times > 1) - 1
            use = times[code] > 1
            row, code = row[use], rank[code[use]]
            by = np.argsort(code, kind="stable")
            row, code = row[by], code[by]
            total = np.zeros((len(a), len(b or a)), np.float32)
            step = max(256, (4 << 20) // max(1, len(sets)))
            top = int(code[-1]) + 1 if len(code) else 0
            for lo in range(0, top, step):
                i, j = np.searchsorted(code, [lo, lo + step])
                x = np.zeros((len(sets), min(step, top - lo)), np.float32)
                x[row[i:j], code[i:j] - lo] = 1
                total += x[: len(a)] @ x[len(a) :].T if b is not None else x @ x.T
            common = total.astype(np.int32)
        both_sizes = size[: len(a), None] + (size[None, len(a) :] if b is not None else size[None, :])
        return common * np.int64(1000 + whole) >= whole * both_sizes

    return linked


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6
) -> DataFrame:
    """One row per document: id, class_id, n_copies, n_text_links, n_links, group_id.

    class_id: least id with the same text; n_copies: documents of that class; n_text_links: other
    texts whose sets of n-word runs have Jaccard similarity of at least the threshold; n_links: other
    documents linked so, copies included; group_id: least id reachable by links. Words are parted by
    ASCII white space and compared as they are. A text of 1 to n-1 words counts as one run; null or
    empty texts are copies of each other and link with no other text. Repeated rows count as copies.
    """
    base = _base(docs, id_col, text_col)
    table = _classes(base, n, threshold, tolerance).drop("component")
    return base.select("id", "key").join(table, "key").drop("key").withColumnRenamed("id", id_col)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), C.text_key(text).alias("key"), text.alias("text"))


def _classes(base: DataFrame, n: int, threshold: float, tolerance: float) -> DataFrame:
    """One row per text: key, what ngram_join says of its rows, and component, the number that names its group."""
    sketched = base.mapInArrow(_sketch(n), "id " + dict(base.dtypes)["id"] + ", key binary, bands array<bigint>, sketch binary, bytes long")
    classes = sketched.groupBy("key").agg(
        F.min("id").alias("class_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("payload"), F.first("bytes").alias("bytes")
    )
    # numbers stand for texts in all that follows; they are written out once and never computed again
    classes = C.checkpoint(classes.withColumnRenamed("key", "text").withColumn("key", F.monotonically_increasing_id()))
    C.release(classes)
    groups = C.candidate_groups(classes.select("key", "bands", "payload"), bayes_kernel(least_matches(threshold, tolerance)))
    chosen = groups.join(classes.select("key", "text", "class_id", "n", "bytes"), "key")
    chosen = C.in_blocks(chosen, F.col("bytes"), BLOCK_ROWS, BLOCK_BYTES)
    # the class's least id names one of its rows, so a class of many copies sends one text; a null id is a name too
    b, c = base.alias("b"), chosen.alias("c")
    texts = b.join(c, (F.col("b.key") == F.col("c.text")) & F.col("b.id").eqNullSafe(F.col("c.class_id")))
    texts = texts.select("c.key", "c.grp", "c.nb", "c.n", "b.text")
    sets = texts.mapInArrow(_runs(n), "key long, grp long, nb int, n long, payload binary")
    found = C.checkpoint(C.linked_groups(sets, jaccard_kernel(threshold)))
    C.release(found)
    # a row that comes twice (same id and text) is its own copy, never a link
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    joined = C.connected_components(found.where("b is not null"))
    least = joined.join(classes.select(F.col("key").alias("node"), "class_id"), "node")
    group = least.join(least.groupBy("component").agg(F.min("class_id").alias("group_id")), "component").select(F.col("node").alias("key"), "group_id", "component")
    table = classes.select("key", "text", "class_id", "n").join(counts, "key", "left").join(group, "key", "left")
    return table.select(
        F.col("text").alias("key"),
        "class_id",
        F.col("n").alias("n_copies"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        (F.coalesce("rows", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("group_id", "class_id").alias("group_id"),
        F.coalesce("component", "key").alias("component"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6
) -> DataFrame:
    """One row of each group of near duplicates, columns unchanged: the first by id, then by a hash of the text.

    Rows without an id come last. Of rows with the same id and text one stays, whatever the others
    hold. Null and empty texts are one group. An empty table stays empty.
    """
    classes = _classes(_base(docs, id_col, text_col), n, threshold, tolerance)
    place = F.struct(F.col("class_id").isNull().alias("none"), F.col("class_id").alias("id"), "key", F.col("n_copies").alias("n"))
    first = classes.groupBy("component").agg(F.min(place).alias("p")).select(F.col("p.id").alias("id"), F.col("p.key").alias("key"), F.col("p.n").alias("n"))
    # whole rows travel in one column, so no name can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), C.text_key(F.col(text_col).cast("string")).alias("key")).alias("r")
    rows = rows.join(first.alias("f"), (F.col("r.key") == F.col("f.key")) & F.col("r.id").eqNullSafe(F.col("f.id"))).select("r.row", "f.key", "f.n")
    # only a text with copies can have several rows of that id
    several = rows.where("n > 1").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.where("n = 1").select("row.*").union(several.select("row.*"))
