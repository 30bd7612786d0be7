"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, components.

Vectors of one label that share all signs of a table, and most of 512 further signs, are candidates.
The number of hyperplanes of a table follows the largest label and the number of tables follows the
wanted recall at the threshold, so buckets stay small as the data grows. Components of candidates are
compared by exact cosines, all members of one with each other; no other link is reported.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C


def _tables(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hyperplanes of a table, and how many tables find a pair at the threshold with that recall."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, largest)))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))


SKETCH = 512


def _most_apart(threshold: float) -> int:
    """Most of SKETCH signs in which a pair at the threshold differs, five deviations above their mean."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def _signs(dim: int, bits: int, tables: int, seed: int):
    """key, the bucket in each table, and the sketch: SKETCH further signs."""

    def work(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, bits * tables + SKETCH)).astype(np.float32)
        weight = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(-1, dim)
                signs = x.astype(np.float32) @ planes >= 0
                side = signs[:, SKETCH:].reshape(len(x), tables, bits)
                code = (side * weight).sum(2, dtype=np.uint64)
                label = np.asarray(b.column(1)).astype(np.uint64)[:, None]
                code = C.mix(C.mix(code + label * np.uint64(0x9E3779B97F4A7C15)) + np.arange(tables, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(code.ravel()))
                sketch = pa.array([r.tobytes() for r in np.packbits(signs[:, :SKETCH], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), lists, sketch], ["key", "bands", "payload"])

    return work


def sign_kernel(most: int):
    def linked(a: list[bytes], b: list[bytes] | None) -> np.ndarray:
        x, y = (np.unpackbits(np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1), axis=1).astype(np.float32) * 2 - 1 for v in (a, a if b is None else b))
        return x @ y.T >= SKETCH - 2 * most  # equal signs less different ones

    return linked


def _unit(batches):
    """Unit vectors in double precision; rows that have none (zero or not finite) go."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            b = batch.slice(lo, 4096)
            keep, out = [], []
            for i, v in enumerate(b.column(2).to_pylist()):
                x = np.array([np.nan if y is None else y for y in v], np.float64)
                big = np.abs(x).max(initial=0)
                if np.isfinite(big) and big > 0:
                    x = x / big
                    keep.append(i)
                    out.append((x / math.sqrt(x @ x)).tobytes())
            took = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(out, pa.binary()), b.column(3).take(took), b.column(4).take(took)], ["key", "code", "payload", "n", "class_id"])


def cosine_kernel(threshold: float):
    def linked(a: list[bytes], b: list[bytes] | None) -> np.ndarray:
        x = np.frombuffer(b"".join(a), np.float64).reshape(len(a), -1)
        y = x if b is None else np.frombuffer(b"".join(b), np.float64).reshape(len(b), -1)
        return x @ y.T >= threshold

    return linked


def embedding_dedup(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.9999, seed: int = 11
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Only vectors with equal, known labels, equal dimension and a direction are compared; null, empty
    and zero vectors and those with null or non-finite parts link with nothing. Repeated rows are
    vectors of their own and link with each other. recall: of pairs exactly at the threshold; closer
    pairs are found more surely. A null id never counts as kept.
    """
    vec = F.col(vec_col).cast("array<double>")
    label = F.coalesce(F.col(label_col).cast("string"), F.lit(""))
    # the label comes with its length, so no label can pass for another with part of a vector
    parts = F.concat_ws(",", F.length(label).cast("string"), label, F.transform(vec, lambda x: F.coalesce(x.cast("string"), F.lit("-"))))
    base = table.select(
        F.col(id_col).alias("id"),
        F.when(F.col(label_col).isNotNull() & (F.size(vec) > 0), F.unhex(F.md5(parts))).alias("key"),
        F.xxhash64(label, F.size(vec)).alias("code"),
        vec.alias("vec"),
    )
    kind = dict(base.dtypes)["id"]
    classes = base.where("key is not null").groupBy("key").agg(F.first("code").alias("code"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("class_id"))
    vectors = classes.select("key", "code", "vec", "n", "class_id").mapInArrow(_unit, f"key binary, code long, payload binary, n long, class_id {kind}")
    # numbers stand for vectors in all that follows; they are written out once and never computed again
    vectors = C.checkpoint(vectors.withColumnRenamed("key", "text").withColumn("key", F.monotonically_increasing_id()))
    shape = vectors.groupBy("code").agg(F.count("*").alias("m"), F.max(F.length("payload")).alias("b")).groupBy("b").agg(F.max("m").alias("m")).collect()
    signed = None
    for row in shape:  # one row for each dimension that occurs
        bits, tables = _tables(row["m"], threshold, recall)
        part = vectors.where(F.length("payload") == row["b"]).select("key", "code", "payload")
        part = part.mapInArrow(_signs(row["b"] // 8, bits, tables, seed), "key long, bands array<bigint>, payload binary")
        signed = part if signed is None else signed.union(part)
    ids = base.select("id", "key")
    if signed is None:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    groups = C.candidate_groups(C.checkpoint(signed), sign_kernel(_most_apart(threshold)))
    # labels share no bucket, so a group has one label and one dimension
    members = C.in_blocks(groups.join(vectors, "key").select("key", "grp", "n", "payload"), F.length("payload"), 2048, 16 << 20)
    found = C.checkpoint(C.linked_groups(members, cosine_kernel(threshold)))
    C.release(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("rows").alias("rows"))
    joined = C.connected_components(found.where("b is not null"))
    least = joined.join(vectors.select(F.col("key").alias("node"), "class_id"), "node")
    lowest = least.groupBy("component").agg(F.min("class_id").alias("low"))
    group = least.join(lowest, "component").select(F.col("node").alias("key"), "low")
    known = vectors.select("key", "text", "n", "class_id").join(counts, "key", "left").join(group, "key", "left")
    known = known.select(F.col("text").alias("key"), (F.coalesce("rows", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("low", "class_id").alias("low"))
    out = ids.join(known, "key", "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("low"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
