"""Quality scores learnt as a Bradley-Terry ranking.

Pairs of a good and a poor labelled document are preferences; a logistic loss on the difference of
their features gives the weights (the model has no intercept, only differences count). All labelled rows
are learnt from, where Spark has dealt them: a pair's loss depends on two scores only, so sums over pairs
come from counts of rows along a grid of scores. A score cut at
the quantile that leaves the labelled share of good documents above it is mapped to `cut`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C

NAMES = ("bytes", "upper", "digit", "mark", "symbol", "space", "high", "lines", "word_length", "closed", "repeats", "variety", "runs_back")
PAIR_BLOCK = 2_000_000
BINS = 8
GRID, COARSE = 2048, 256
PARTS = 32


def _classes() -> np.ndarray:
    t = np.zeros((256, 7), np.float32)
    t[ord("A") : ord("Z") + 1, 0] = 1
    t[ord("0") : ord("9") + 1, 1] = 1
    for c in b".,;:!?'\"()-":
        t[c, 2] = 1
    for c in b"*#$%&|@^~<>{}[]\\/_=+`":
        t[c, 3] = 1
    t[C.SPACES, 4] = 1
    t[128:, 5] = 1
    t[10, 6] = 1
    return t


def features(texts: pa.Array) -> np.ndarray:
    """(texts, len(NAMES)) float64; zeros for an empty text."""
    data, offs = C.utf8(texts)
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, len(NAMES)))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    table = _classes()
    out[:, 0] = np.log1p(size)
    for k in range(7):
        out[full, 1 + k] = np.add.reduceat(table[data, k], offs[full], dtype=np.float64) / size[full]
    starts, ends, h, first = C.words(data, offs)
    count = np.diff(first)
    some = np.flatnonzero(count)
    if len(some):
        length = (ends - starts).astype(np.float64)
        total = lambda x: np.add.reduceat(x.astype(np.float64), first[some])
        c = count[some]
        out[some, 8] = np.minimum(total(length) / c, 40)
        out[some, 9] = total(table[data[ends - 1], 2]) / c
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[first[some]] = False
        out[some, 10] = total(same) / c
        for i in some:
            w = h[first[i] : first[i + 1]]
            out[i, 11] = len(np.unique(w)) / np.sqrt(len(w))
            p = w[:-1] * np.uint64(3) + w[1:]
            out[i, 12] = 1 - len(np.unique(p)) / len(p) if len(p) else 0
    return out


def _expand(x: np.ndarray, edges: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised features, and a step for each inner quantile a feature has passed."""
    z = np.clip((x - mean) / std, -4, 4)
    steps = (x[:, :, None] >= edges[None]).reshape(len(x), -1)
    return np.concatenate([z, steps.astype(np.float64)], axis=1)


def pair_sums(good: np.ndarray, poor: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean gradient and Hessian of the logistic loss over every pair of a good and a poor row, in blocks of pairs: what fit() is tested against.

    A difference of features never stands alone: sums over pairs are sums over rows, weighted by the
    sums of the pairs' probabilities along either side.
    """
    up, down = good @ w, poor @ w
    g_rows, p_rows = np.zeros(len(good)), np.zeros(len(poor))
    g_curve, p_curve = np.zeros(len(good)), np.zeros(len(poor))
    cross = np.zeros((len(w), len(w)))
    rows = max(1, PAIR_BLOCK // len(poor))
    for lo in range(0, len(good), rows):
        at = slice(lo, lo + rows)
        p = 1 / (1 + np.exp(np.clip(up[at, None] - down[None, :], -30, 30)))
        g_rows[at] = p.sum(1)
        p_rows += p.sum(0)
        p *= 1 - p
        g_curve[at] = p.sum(1)
        p_curve += p.sum(0)
        cross += good[at].T @ (p @ poor)
    n = len(good) * len(poor)
    grad = (poor.T @ p_rows - good.T @ g_rows) / n
    hess = ((good * g_curve[:, None]).T @ good + (poor * p_curve[:, None]).T @ poor - cross - cross.T) / n
    return grad, hess


def _total(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows (x, y) of the vector that work gives for a batch; a vector for each of few partitions reaches the driver."""

    def scan(batches):
        total = 0.0
        for b in batches:
            if b.num_rows:
                total = total + work(np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1), np.asarray(b.column(1)))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return sum((np.frombuffer(r["total"]) for r in rows.mapInArrow(scan, "total binary").collect()), np.zeros(1))


def _edges(rows: DataFrame, count: int) -> np.ndarray:
    """(features, BINS - 1) inner quantiles over all rows, to three digits: values are counted by their first ten bits."""

    def scan(batches):
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
            m, e = np.frexp(x)
            cut = np.ldexp(np.floor(m * 1024) / 1024, e)
            for k in range(cut.shape[1] if len(cut) else 0):
                v, n = np.unique(cut[:, k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(n, pa.int64())], ["k", "v", "n"])

    by = rows.mapInArrow(scan, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toArrow()
    k, v, n = (np.asarray(by[c]) for c in ("k", "v", "n"))
    out = np.zeros((len(NAMES), BINS - 1))
    for i in range(len(NAMES)):
        own = np.flatnonzero(k == i)
        own = own[np.argsort(v[own])]
        at = np.searchsorted(np.cumsum(n[own]), np.arange(1, BINS) / BINS * (count - 1), "right")
        out[i] = v[own][at]
    return out


def _near(s: np.ndarray, low: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The four grid points about each score, and the weights of a cubic through them."""
    u = (s - low) / step
    at = np.floor(u).astype(np.int64)
    f = u - at
    w = np.stack([-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6])
    return at + np.arange(-1, 3)[:, None], w


def fit(rows: DataFrame, cut: float = 0.3, ridge: float = 1e-3) -> dict:
    """Weights of the ranking from all rows (x, y), by Newton steps on the logistic loss over all preference pairs.

    Gradients are those over all pairs to eight digits or more (cubics between the points of a grid of
    scores); the curvature takes scores to the nearest of COARSE points, which bears on the number of steps only.
    Without labels, or with labels of one kind only, there are no preferences and every score is that
    share: 1 where all known labels are good, 0 where all are poor, 0.5 without any.
    """
    d = len(NAMES)
    sums = _total(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    if len(sums) == 1:
        sums = np.zeros(2 + 2 * d)
    n, good = int(sums[0]), int(sums[1])
    mean = sums[2 : 2 + d] / max(n, 1)
    std = np.maximum(np.sqrt(np.maximum(sums[2 + d :] / max(n, 1) - mean**2, 0)), 1e-9)
    model = {"mean": mean, "std": std, "edges": np.zeros((d, BINS - 1)), "w": np.zeros(d * BINS), "at": 0.0, "scale": 1.0, "base": cut}
    if good in (0, n):
        return model | {"base": good / n if n else 0.5}
    edges = _edges(rows, n)
    expand = lambda x: _expand(x, edges, mean, std)
    w, pairs = np.zeros(d * BINS), good * (n - good)

    def grid(w: np.ndarray) -> tuple[float, float]:
        reach, steps = 4 * np.abs(w[:d]).sum(), w[d:]
        low, high = np.minimum(steps, 0).sum() - reach, np.maximum(steps, 0).sum() + reach
        step = max(high - low, 1e-3) / (GRID - 8)
        return low - 4 * step, step

    def counts(w: np.ndarray) -> np.ndarray:
        """Poor and good rows at each point of the grid and of the coarse one, sum and sum of squares of the scores."""
        low, step = grid(w)

        def work(x, y):
            s = expand(x) @ w
            at, part = _near(s, low, step)
            own = np.rint((s - low) / step * COARSE / GRID).astype(np.int64)
            fine = [np.bincount(at[:, y == k].ravel(), part[:, y == k].ravel(), GRID) for k in (0, 1)]
            return np.concatenate([*fine, *[np.bincount(own[y == k], minlength=COARSE + 1).astype(float) for k in (0, 1)], [s.sum(), (s * s).sum()]])

        return _total(rows, work)

    for _ in range(30):
        low, step = grid(w)
        c = counts(w)
        poor_at, good_at = c[:GRID], c[GRID : 2 * GRID]
        poor_near, good_near = c[2 * GRID : -2].reshape(2, COARSE + 1)
        point = np.arange(GRID) * step
        p = 1 / (1 + np.exp(np.clip(point[:, None] - point[None, :], -700, 700)))  # of a good row's score and a poor one's
        slope = np.stack([good_at @ p, p @ poor_at])
        point = np.arange(COARSE + 1) * step * GRID / COARSE
        q = 1 / (1 + np.exp(np.clip(point[:, None] - point[None, :], -700, 700)))
        q *= 1 - q
        curve = np.stack([good_near @ q, q @ poor_near])

        def work(x, y, w=w, low=low, step=step, slope=slope, curve=curve):
            e = expand(x)
            s = e @ w
            at, part = _near(s, low, step)
            own = np.rint((s - low) / step * COARSE / GRID).astype(np.int64)
            pull = (slope[y, at] * part).sum(0) * (1 - 2 * y)
            points = [(np.arange(COARSE + 1)[:, None] == own[y == k][None, :]).astype(float) @ e[y == k] for k in (0, 1)]
            return np.concatenate([pull @ e, ((e * curve[y, own][:, None]).T @ e).ravel(), *[a.ravel() for a in points]])

        t = _total(rows, work)
        k = len(w)
        grad, hess = t[:k] / pairs, t[k : k + k * k].reshape(k, k)
        poor_sum, good_sum = t[k + k * k :].reshape(2, COARSE + 1, k)
        cross = good_sum.T @ (q @ poor_sum)
        move = np.linalg.solve((hess - cross - cross.T) / pairs + ridge * np.eye(k), grad + ridge * w)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    low, step = grid(w)
    c = counts(w)
    below = np.maximum.accumulate(np.cumsum(c[:GRID] + c[GRID : 2 * GRID]))
    at = np.interp((n - good) / n * (n - 1), below, low + (np.arange(GRID) + 0.5) * step)
    raw = c[-2:] / n
    return model | {"edges": edges, "w": w, "at": float(at), "scale": float(max(np.sqrt(max(raw[1] - raw[0] ** 2, 0)), 1e-9))}


def scorer(model: dict, cut: float = 0.3) -> Callable[[np.ndarray], np.ndarray]:
    """Features to scores in 0..1, rising with the rank; `cut` stands for the quantile threshold."""
    shift = np.log(cut / (1 - cut))

    def score(x: np.ndarray) -> np.ndarray:
        if not model["w"].any():
            return np.full(len(x), model["base"])
        raw = _expand(x, model["edges"], model["mean"], model["std"]) @ model["w"]
        z = (raw - model["at"]) / model["scale"] * 2 + shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return score


def _feature_scan(batches):
    for batch in C.slices(batches):
        x = features(batch.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "x"])


def held_out(id_col) -> F.Column:
    """Whether a row's label may not be learnt from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", cut: float = 0.3) -> dict:
    """The model from (id, x) and labels: every labelled row counts, but those held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("id"), F.col("quality").cast("long").alias("y"))
    # few partitions, as each sends its sums; the rows are of len(NAMES) numbers
    rows = C.Written(feats.join(known, "id").select("x", "y").repartition(PARTS))
    model = fit(rows.table.coalesce(PARTS), cut)
    rows.drop()
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= cut).

    Only the text enters a score. Null and empty texts have the features of no bytes and are scored
    like others, texts of any length are read whole, and equal texts score alike (a tie with the cut counts
    as reached). Rows without an id are scored and never learnt from. Labels without rows, null labels
    and labels of unknown documents are ignored; see fit() for tables with too few labels. Repeated rows
    are rows of their own, other columns are not read, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    feats = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_feature_scan, f"id {kind}, x array<double>")
    feats = C.checkpoint(feats)
    score = scorer(learn(feats, labels, id_col, cut), cut)

    def scan(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(x))], ["id", "score"])

    out = feats.mapInArrow(scan, f"id {kind}, score double")
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The documents whose score reaches the cut, columns and order of columns unchanged.

    The text alone decides: null and empty texts are scored like others, equal texts share their fate,
    and rows without an id or of one id are rows of their own. An empty table stays empty.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string").alias("text")
    # features are joined with labels, texts are not moved
    feats = docs.select(F.col(id_col).alias("id"), text).mapInArrow(_feature_scan, f"id {kind}, x array<double>")
    score = scorer(learn(feats, labels, id_col, cut), cut)
    at = docs.columns.index(text_col)

    def scan(batches):
        for b in C.slices(batches, text_col):
            yield b.take(pa.array(np.flatnonzero(score(features(b.column(at))) >= cut)))

    return docs.mapInArrow(scan, docs.schema)
