"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every document is a query against the index. Impacts are divided by what an item
scores against itself, so one threshold serves all items. Postings are ordered by item and cut into
blocks with their largest impact. WAND (Broder et al., 2003; Ding and Suel, 2011) moves a cursor in
each posting list of the passage's terms: the first item that the largest impacts could lift to the
threshold is the pivot, and it is scored only if its blocks' largest impacts still reach the threshold,
else the cursors skip past the nearest block. A passage whose terms' largest impacts don't reach the
threshold has no pivot at all; that test, and the one of the blocks that its terms are in, is made for all
passages of a slice at once, so that cursors move only in blocks that may hold an item.
Everything at or above the threshold is verified: the word runs of the item's question and answer must
occur in the passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm import common as C

#: Bytes of text of the items of one index; a larger benchmark is searched in several passes over the documents.
INDEX_BYTES = 8 << 20
#: Items of a block, and most sums of (step, block) held at once.
BLOCK, SUMS = 4, 4 << 20
K1, B = 1.2, 0.75

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_GAP = np.ones(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _GAP[_lo : _hi + 1] = False


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return C.words(data, np.array([0, len(data)]), _GAP, _FOLD)[2]


def _runs(h: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """Run length (n, or all words of a shorter part) and the different runs."""
    m = max(1, min(n, len(h)))
    return m, np.unique(C.word_runs(h, np.array([0, len(h)]), m)[0])


def _share(part: tuple[int, np.ndarray], h: np.ndarray) -> float:
    """How much of a part's runs the words h hold; 1 for a part without words."""
    m, runs = part
    if not len(runs):
        return 1.0
    if len(h) < m:
        return 0.0
    return float(np.isin(runs, C.word_runs(h, np.array([0, len(h)]), m)[0]).mean())


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's question and its answer: its last sentence, or the last third of a single one's words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1 and re.search(r"\w", " ".join(parts[:-1])):
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    k = max(1, len(w) - len(w) // 3)
    return " ".join(w[:k]), " ".join(w[k:])


def _terms(batches):
    """item, its words, and how often it has each term."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _hashes(text or "")
            t, tf = np.unique(h, return_counts=True)
            if len(t):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(t), batch.schema.field(0).type), pa.array(np.full(len(t), len(h))), pa.array(t.view(np.int64)), pa.array(tf)], ["item", "words", "term", "tf"]
                )


class Index:
    """Inverted index of items (id, text), with the postings (item, words, term, tf, df) of exactly these items.

    count and mean: number and mean words of all items, and df counts in all of them, so that a score
    doesn't depend on which items share an index.
    """

    def __init__(self, items: list[tuple[object, str]], postings: pa.Table, n: int, count: int, mean: float, longest: int):
        self.ids = [i for i, _ in items]
        self.longest = longest
        parts = [tuple(_runs(_hashes(p), n) for p in question_and_answer(t)) for _, t in items]
        self.question, self.answer = [p[0] for p in parts], [p[1] for p in parts]
        at = {i: k for k, i in enumerate(self.ids)}
        item = np.array([at[i] for i in postings["item"].to_pylist()], np.int64)
        words, tf, df = (np.asarray(postings[c], dtype=np.float64) for c in ("words", "tf", "df"))
        self.terms, code = np.unique(np.asarray(postings["term"]).view(np.uint64), return_inverse=True)
        impact = np.log1p((count - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words / mean))
        own = np.bincount(item, impact, minlength=len(items))
        by = np.lexsort((item, code))
        self.item, self.impact = item[by], (impact / own[item])[by]
        begin = self.begin = np.searchsorted(code[by], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, begin[:-1]) if len(self.terms) else np.zeros(0)
        # the blocks of items that each term is in, with its largest impact there
        block = self.item // BLOCK
        new = np.append(True, block[1:] != block[:-1]) if len(block) else np.zeros(0, bool)
        new[begin[:-1]] = True
        at = np.flatnonzero(new)
        self.block, self.block_most = block[at], np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.block_begin = np.searchsorted(at, begin)
        self.blocks = -(-len(items) // BLOCK)
        cut = lambda x, edges: [x[lo:hi].tolist() for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        self.lists = list(zip(cut(self.item, begin), cut(self.impact, begin), cut(self.block, self.block_begin), cut(self.block_most, self.block_begin), strict=True))

    def step_bounds(self, step: np.ndarray, term: np.ndarray, steps: int) -> np.ndarray:
        """(steps, blocks): the most that an item of the block can score for the terms of a step, by walking the terms' lists of blocks."""
        n = self.block_begin[term + 1] - self.block_begin[term]
        post = np.repeat(self.block_begin[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.repeat(step, n) * np.int64(self.blocks) + self.block[post]
        return np.bincount(key, self.block_most[post], steps * self.blocks).reshape(steps, self.blocks)

    def search(self, terms: list[int], least: float, where: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items in the blocks `where` that score at least `least` for the terms, by block-max WAND."""
        cursors = [[0, *self.lists[t], float(self.most[t])] for t in terms]  # place, items, impacts, blocks, their largest impacts, largest impact
        out = []
        while True:
            cursors = [c for c in cursors if c[0] < len(c[1])]
            cursors.sort(key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[5]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][1][cursors[pivot][0]]
            j = bisect_left(where, item // BLOCK)
            if j == len(where):
                return out
            skip = where[j] * BLOCK
            if skip <= item:
                while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                    pivot += 1
                bound = 0.0
                for c in cursors[: pivot + 1]:
                    b = bisect_left(c[3], where[j])
                    if b < len(c[3]) and c[3][b] == where[j]:
                        bound += c[4][b]
                if bound >= least:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        c[0] = bisect_left(c[1], item, c[0])
                        if c[0] < len(c[1]) and c[1][c[0]] == item:
                            score += c[2][c[0]]
                            c[0] += 1
                    if score >= least:
                        out.append((item, round(score, 9)))
                    continue
                # no item up to the end of the block, or before the next cursor's item, can reach the threshold
                skip = (where[j] + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    skip = min(skip, cursors[pivot + 1][1][cursors[pivot + 1][0]])
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(c[1], skip, c[0])


def _search(held, n: int, least: float, overlap: float, kind: pa.DataType):
    def work(batches):
        index = held.value
        size = max(32, index.longest)  # two steps make a passage, so any item lies whole in one
        for batch in C.slices(batches):
            data, offs = C.utf8(batch.column(1))
            _, _, h, first = C.words(data, offs, _GAP, _FOLD)
            if not len(h) or not len(index.terms):
                continue
            at = np.searchsorted(index.terms, h)
            at[at == len(index.terms)] = 0
            known = index.terms[at] == h
            count = np.diff(first)
            steps = -(-count // size)
            step0 = np.concatenate([[0], np.cumsum(steps)])
            doc = np.repeat(np.arange(len(count)), count)
            step = step0[doc] + (np.arange(len(h)) - first[doc]) // size
            key = np.unique(step[known] * np.int64(len(index.terms)) + at[known])
            step_of, term = key // len(index.terms), key % len(index.terms)
            bounds = np.searchsorted(step_of, np.arange(step0[-1] + 1))
            last = np.zeros(step0[-1], bool)
            last[step0[1:][steps > 0] - 1] = True
            bound = np.bincount(step_of, index.most[term], minlength=step0[-1])
            bound[:-1] += np.where(last[:-1], 0, bound[1:])
            step_doc = np.repeat(np.arange(len(count)), steps)
            rows: dict[tuple[int, int], tuple] = {}
            # terms that a step shares with the next one count once in the passage of both
            shared = ~last[step_of] & np.isin(key + len(index.terms), key, assume_unique=True)
            hits: list[tuple[int, list[int]]] = []
            width = max(2, SUMS // max(1, index.blocks))
            for lo in range(0, int(step0[-1]), width - 1):  # the last step of a part is the first of the next
                hi = min(lo + width, int(step0[-1]))
                if not (bound[lo:hi] >= least - 1e-9).any():
                    continue
                i, j = bounds[lo], bounds[hi]
                sums = index.step_bounds(step_of[i:j] - lo, term[i:j], hi - lo)
                sums[:-1] += np.where(last[lo : hi - 1, None], 0, sums[1:])
                sums -= index.step_bounds(step_of[i:j][shared[i:j]] - lo, term[i:j][shared[i:j]], hi - lo)
                if hi < step0[-1]:
                    sums = sums[:-1]
                p, block = np.nonzero(sums >= least - 1e-9)
                cuts = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else []
                hits += [(lo + int(p[k]), x.tolist()) for k, x in zip(cuts, np.split(block, cuts[1:]) if len(p) else [], strict=True)]
            for p, where in hits:
                t = term[bounds[p] : bounds[p + 1]]
                if not last[p]:
                    t = np.union1d(t, term[bounds[p + 1] : bounds[p + 2]])
                i = int(step_doc[p])
                for k, score in index.search(t.tolist(), least - 1e-9, where):
                    lo = first[i] + (p - step0[i]) * size
                    passage = h[lo : min(lo + 2 * size, first[i + 1])]
                    q, a = _share(index.question[k], passage), _share(index.answer[k], passage)
                    if q >= overlap and a >= overlap:
                        old = rows.get((i, k))
                        if old is None or (score, q, a) > old:
                            rows[i, k] = (score, q, a)
            if rows:
                docs, items = pa.array([i for i, _ in rows]), [index.ids[k] for _, k in rows]
                cols = list(zip(*rows.values(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(docs), pa.array(items, kind), *(pa.array(c, pa.float64()) for c in cols)], ["id", "item", "score", "question_overlap", "answer_overlap"]
                )

    return work


def _indexes(items: DataFrame, n: int, index_bytes: int):
    """Index by index of items (item, text), each of about index_bytes of text; a larger item is alone in one.

    Term counts, document frequencies and lengths are computed by Spark over all items; the driver holds
    one part at a time.
    """
    # rows stand for items by number, so null and repeated ids are items of their own
    own = C.checkpoint(items.where("text is not null").withColumn("no", F.monotonically_increasing_id()))
    size = F.octet_length("text").cast("long")
    # parts from running sums of bytes inside each file partition's numbers
    split = F.shiftright("no", 33)
    run = F.sum(size).over(Window.partitionBy(split).orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    own = C.checkpoint(own.withColumn("part", F.struct(split.alias("s"), F.floor((run - 1) / index_bytes).alias("k"))))
    kind = "item long, words long, term long, tf long"
    terms = C.checkpoint(own.select("no", "text").mapInArrow(_terms, kind))
    whole = terms.select("item", "words").distinct().agg(F.count("*").alias("n"), F.avg("words").alias("mean"), F.max("words").alias("longest")).first()
    if not whole["n"]:
        return
    postings = terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term").join(own.select(F.col("no").alias("item"), "part"), "item")
    postings = C.checkpoint(postings)
    small = own.groupBy("part").agg(F.sum(size).alias("bytes"))
    # small parts share an index
    group, held, groups = [], 0, []
    for r in small.orderBy("part").collect():
        if group and held + r["bytes"] > index_bytes:
            groups.append(group)
            group, held = [], 0
        group.append(r["part"])
        held += r["bytes"]
    for parts in [*groups, group]:
        chosen = F.col("part").isin([F.struct(F.lit(p["s"]).alias("s"), F.lit(p["k"]).alias("k")) for p in parts])
        table = postings.where(chosen).select("item", "words", "term", "tf", "df").orderBy("item", "term").toArrow()
        if not table.num_rows:
            continue
        some = own.where(chosen).join(terms.select(F.col("item").alias("no")).distinct(), "no", "left_semi").orderBy("no").toArrow()
        texts = list(zip(some["no"].to_pylist(), some["text"].to_pylist(), strict=True))
        index = Index(texts, table, n, whole["n"], whole["mean"], whole["longest"])
        index.ids = some["item"].to_pylist()
        yield index, some["item"].type


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = 5, least: float = 0.5, overlap: float = 0.8, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """One row per document and item it holds: id, item_id, score, question_overlap, answer_overlap.

    An item is held when some passage (two steps of as many words as the longest item, at least 32)
    scores at least `least` of the item's own score and holds at least `overlap` of the n-word runs of
    its question and of its answer. Words are runs of ASCII letters and digits and of other characters
    beyond ASCII, in lower case. Null and empty texts hold nothing; items without words are never
    held; items with a null or repeated id are items of their own; repeated rows give repeated rows. The
    best passage of a document is reported. The index is sent to the executors in parts of about
    index_bytes of item text; scores follow from all items together, so parts don't change them. No
    documents or no items give no rows.
    """
    doc_kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {doc_kind}, item {item_kind}, score double, question_overlap double, answer_overlap double"
    own = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, (index, kind) in enumerate(_indexes(own, n, index_bytes)):
        held = docs.sparkSession.sparkContext.broadcast(index)
        found = base.mapInArrow(_search(held, n, least, overlap, kind), schema)
        out = out.union(found) if k else found
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that hold no item, columns unchanged. The text alone decides, whatever its id.

    Null and empty texts stay, rows that come twice stay twice, and no items leave all documents.
    """
    key = C.text_key(F.col(text_col).cast("string")).alias("key")
    held = contaminated(docs.select(key, F.col(text_col).alias("text")), items, "key", "text", **how).select("key").distinct()
    # whole rows travel in one column, so no name can clash
    rows = docs.select(key, F.struct("*").alias("row"))
    return rows.join(held, "key", "left_anti").select("row.*")
