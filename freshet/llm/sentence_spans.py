"""Substring dedup by sliding spans of sentences.

Every run of several consecutive sentences is hashed (128 bits), as is every single sentence that is
long, and the hashes meet in one global grouping. All occurrences but the first (by document, then
place) mark their sentences. Longer runs are covered by the runs in them, so every repeated run counts,
however short its sentences are. Marked sentences that follow each other are one repeated stretch; a
stretch goes if it has enough words, so that a stock phrase is no reason to cut a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C

_END = np.zeros(256, bool)
_END[[ord("."), ord("!"), ord("?"), 10]] = True


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each sentence (and the end of the bytes), and the index of each text's first sentence.

    A sentence ends after a run of . ! ? or line ends, with the white space that follows; the end of a
    text ends its last one. Sentences tile the text.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64), np.zeros(0, bool)
    tail = _END[data]
    space = C.SPACES[data]
    # a byte opens a sentence if it is neither end nor space and the last byte that isn't space is an end
    solid = np.where(~space | tail, np.arange(n), -1)
    last = np.maximum.accumulate(solid)
    before = np.concatenate([[-1], last[:-1]])
    opens = ~space & ~tail & (before >= 0) & tail[np.maximum(before, 0)]
    opens[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(opens)
    return np.append(starts, n), np.searchsorted(starts, offs), opens


_U = np.uint64


def _spans(run: int, long_words: int):
    """id, k, and for each run of sentences its place and hash; the place of a single sentence is given as -1 - place."""

    def work(batches):
        for batch in C.slices(batches):
            data, offs = C.utf8(batch.column(1))
            starts, first, _ = sentences(data, offs)
            _, _, h, wfirst = C.words(data, starts)
            count = np.diff(wfirst)
            # a sentence's hash depends on its words, not on the white space between them
            sent = np.zeros((2, len(count)), _U)
            if len(h):
                place = C.mix((np.arange(len(h)) - np.repeat(wfirst[:-1], count)).astype(_U))
                some = np.flatnonzero(count)
                for lane, salt in enumerate((_U(1), _U(0x9E3779B97F4A7C15))):
                    sent[lane, some] = np.add.reduceat(C.mix((h ^ salt) + place), wfirst[some])
            sent = C.mix(sent + count.astype(_U))
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(count))
            whole = at[at + run <= first[doc + 1]]
            hash_ = np.zeros((2, len(whole)), _U)
            for k in range(run):
                hash_ = C.mix(hash_ * _U(3) + sent[:, whole + k])
            single = at[count > long_words] if run > 1 else at[:0]
            lo = np.concatenate([whole, single])
            place = lo - first[doc[lo]]
            place[len(whole) :] = -1 - place[len(whole) :]
            hash_ = np.concatenate([hash_, C.mix(sent[:, single] ^ _U(5))], axis=1).view(np.int64)
            d = pa.array(doc[lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(d), batch.column(2).take(d), pa.array(place, pa.int32()), pa.array(hash_[0]), pa.array(hash_[1])], ["id", "k", "at", "h1", "h2"]
            )

    return work


def _cut(run: int, least_words: int):
    def work(batches):
        for batch in C.slices(batches):
            data, offs = C.utf8(batch.column(1))
            starts, first, _ = sentences(data, offs)
            total = C.words(data, starts)[3]
            marked = batch.column(2).to_pylist()
            rows = []
            for i in range(batch.num_rows):
                n = int(first[i + 1] - first[i])
                gone = np.zeros(n + 2, bool)
                for at in marked[i] or ():
                    lo, hi = (at + 1, at + 1 + run) if at >= 0 else (-at, 1 - at)
                    gone[lo:hi] = True
                edge = np.flatnonzero(gone[1:] != gone[:-1])
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    if total[first[i] + b] - total[first[i] + a] < least_words:
                        gone[a + 1 : b + 1] = False
                gone = gone[1:-1]
                lo, hi = offs[i], offs[i + 1]
                if gone.any():
                    edges = np.append(starts[first[i] : first[i + 1]], hi)
                    edges[0] = lo
                    kept = b"".join(data[a:b].tobytes() for a, b, g in zip(edges, edges[1:], gone, strict=False) if not g)
                else:
                    kept = data[lo:hi].tobytes()
                rows.append((n, int(gone.sum()), int(hi - lo), int(hi - lo) - len(kept), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["id", "n_sentences", "n_removed", "n_bytes", "n_removed_bytes", "kept_sha256", "kept"],
            )

    return work


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, least_words: int = 0, long_words: int = 50) -> DataFrame:
    """One row per document: id, n_sentences, n_removed, n_bytes, n_removed_bytes, kept_sha256, kept (the text that stays).

    A span is any run of `run` consecutive sentences (so any longer one is covered by spans), or a
    single sentence of more than long_words words. Sentences covered by a span that occurs earlier are
    removed, whatever their length; with least_words, only where such sentences, in a row, have as many
    words. Texts are read whole, however long, and other columns are not read. "Earlier" is by
    id, then by the text's hash (for ids that occur twice), then by place, so later repeats inside a
    document go too. Rows without an id come last. Equal rows share one fate: a repeated row (same id
    and text) keeps what its twin keeps. Null and empty texts have no sentences; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # a hash of the text tells rows without an id, or of one id, apart
    base = base.select("id", "text", F.xxhash64(text).alias("k"))
    spans = C.Written(base.mapInArrow(_spans(run, long_words), f"id {kind}, k long, at int, h1 long, h2 long"))
    # the first place of each span is a minimum, combined map-side; the join can be split at a hot span
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"))
    first = spans.table.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").select("h1", "h2", "first")
    # null-safe: places of rows without an id are compared too
    later = spans.table.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "k", "at")
    marks = C.checkpoint(later.groupBy("id", "k").agg(F.collect_set("at").alias("marks")))
    spans.drop()
    C.release(marks)
    b, m = base.alias("b"), marks.alias("m")
    both = b.join(m, F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.k") == F.col("m.k")), "left").select("b.id", "b.text", "m.marks")
    out = both.mapInArrow(_cut(run, least_words), f"id {kind}, n_sentences long, n_removed long, n_bytes long, n_removed_bytes long, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col)
