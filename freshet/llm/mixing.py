"""Mixing to target weights with soft membership, in DataFrame functions only.

A Bernoulli naive Bayes classifier over learnt marker words, trained from a labelled table, gives each
document a posterior over domains. Nonnegative rates per document are then fitted so that the expected
tokens of each domain meet their targets: projected gradient steps on a weighted least-squares loss,
each one aggregate over the documents. Only sums per domain reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C
from freshet.llm.spans import let

SAMPLE_ROWS = 20_000
#: Most marker words of each domain.
MARKERS = 48
LIFT = 3.0
#: Sums of tokens are sums of whole parts of this size, so they don't depend on the order of rows.
PARTS = 1024


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _evidence(text: Column) -> Column:
    """Words, shapes of words (letters and digits as one, signs as they are), and how varied the words are, in tenths.

    Shapes stand apart by a blank in front. Which of all this says anything is learnt.
    """
    words = F.split(F.lower(text), r"[^\p{L}\p{Nd}]++")
    shapes = F.array_distinct(F.split(F.regexp_replace(text, r"[\p{L}\p{Nd}]++", "a"), r"\s++"))

    def gathered(x: Column) -> Column:
        all_, own = x["all"], x["own"]
        varied = F.concat(F.lit(" varied "), F.floor(F.size(own) * 10 / F.size(all_)).cast("string"))
        return F.concat(F.array(varied), F.transform(x["shapes"], lambda w: F.concat(F.lit(" "), w)), F.filter(own, lambda w: w != ""))

    # bound to names, so that nothing is computed twice
    return let(words, lambda w: let(F.struct(w.alias("all"), F.array_distinct(w).alias("own"), shapes.alias("shapes")), gathered))


def learn_domains(docs: DataFrame, labels: DataFrame, domain: Column, names: Sequence[str], id_col: str, text_col: str, sample_rows: int, markers: int) -> tuple[list[float], dict[str, list[float]]]:
    """Log prior of each domain with all markers absent, and what a present marker adds to it.

    At most sample_rows labelled rows are used, taken by a hash of their id.
    """
    known = labels.select(F.col(id_col).alias("id"), domain.cast("string").alias("domain")).where(F.col("domain").isin(*names) & F.col("id").isNotNull())
    known = known.orderBy(F.xxhash64("id"), "id", "domain").limit(sample_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # known is bounded by sample_rows
    sample = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(known), "id").select("domain", F.array_distinct(_evidence(F.col("text"))).alias("w"))
    sample = C.checkpoint(sample)
    size = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [size.get(k, 0) for k in names]
    total = sum(n)
    prior = [math.log((x + 1) / (total + len(n))) for x in n]
    if not total:
        return prior, {}
    seen = C.checkpoint(sample.select("domain", F.explode("w").alias("w")).groupBy("w").agg(*[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{i}") for i, k in enumerate(names)]))
    every = sum(F.col(f"n{i}") for i in range(len(n)))
    picked = set()
    for i, x in enumerate(n):  # a marker is at least LIFT times as frequent in a domain as elsewhere
        lift = ((F.col(f"n{i}") + 0.5) / (x + 1)) / ((every - F.col(f"n{i}") + 0.5) / (total - x + 1))
        own = seen.where((lift >= LIFT) & (F.col(f"n{i}") >= 3)).withColumn("gain", F.col(f"n{i}") * F.log(lift))
        picked.update(own.orderBy(F.col("gain").desc(), "w").limit(markers).collect())
    picked = {r["w"]: r for r in picked}
    base, weight = list(prior), {}
    for _, r in sorted(picked.items()):
        p = [(r[f"n{i}"] + 0.5) / (x + 1) for i, x in enumerate(n)]
        weight[r["w"]] = [math.log(x) - math.log1p(-x) for x in p]
        base = [b + math.log1p(-x) for b, x in zip(base, p, strict=True)]
    return base, weight


def with_posterior(rows: DataFrame, base: Sequence[float], weight: dict[str, list[float]]) -> DataFrame:
    """rows with p, array<double>: the probability of each domain.

    In steps, as an expression inside a lambda would be computed for each element.
    """
    logs = F.array(*[F.lit(b) for b in base])
    if weight:
        table = F.create_map(*[x for w, v in weight.items() for x in (F.lit(w), F.array(*[F.lit(y) for y in v]))])
        rows = rows.withColumn("hits", F.array_intersect(_evidence(F.col("text")), F.array(*[F.lit(w) for w in weight])))
        logs = F.aggregate("hits", logs, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
    rows = rows.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    rows = rows.withColumn("raised", F.transform("logs", lambda x: F.exp(F.greatest(x - F.col("top"), F.lit(-700.0)))))
    rows = rows.withColumn("mass", F.aggregate("raised", F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn("p", F.transform("raised", lambda x: x / F.col("mass"))).drop("hits", "logs", "top", "raised", "mass")


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """m x = v for a small positive definite m, by elimination with pivots."""
    a = [[*row, y] for row, y in zip(m, v, strict=True)]
    for i in range(len(a)):
        p = max(range(i, len(a)), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(len(a)):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[-1] / row[i] for i, row in enumerate(a)]


def fit_rates(rows: DataFrame, targets: Sequence[float], rounds: int = 40, tolerance: float = 1e-4, keep: int = 4) -> DataFrame:
    """rows (tokens, p) with rate, nonnegative: a projected gradient step for each round.

    The loss is the squared distance of expected domain tokens from the targets. A step is taken in the
    metric of the token-weighted Gram matrix of the rows whose rate is above 0, with a tenth of that of
    all rows so that it stays bounded. The rates are written out every `keep` rounds, so the expression
    of a rate never grows with the rounds. The best rates met are returned.
    """
    k = range(len(targets))
    rows, rate = rows.withColumn("rate", F.lit(1.0)), F.col("rate")
    best, best_gap = rows, float("inf")
    tok = F.col("tokens").cast("double")
    pairs = [(i, j) for i in k for j in k if i <= j]
    whole: dict[tuple[int, int], float] = {}
    for done in range(1, rounds + 1):
        now = rows.withColumn("rate", rate)
        on = F.when(F.col("rate") > 0, tok)
        whole_parts = lambda x: F.sum(F.round(x * PARTS).cast("long"))
        got = now.agg(
            *[whole_parts(tok * F.col("p")[i] * F.col("rate")).alias(f"s{i}") for i in k],
            *[whole_parts(on * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i, j in pairs],
        ).first()
        gram = {ij: (got[f"g{ij[0]}_{ij[1]}"] or 0) / PARTS for ij in pairs}
        whole = whole or gram
        scale = sum(whole[i, i] for i in k)
        gap = [(got[f"s{i}"] or 0) / PARTS - targets[i] for i in k]
        size = max(map(abs, gap)) / max(sum(targets), 1e-300)
        if size < best_gap:
            best, best_gap = now, size
        if scale <= 0 or size < tolerance:
            break
        at = lambda i, j: gram[min(i, j), max(i, j)] + 0.1 * whole[min(i, j), max(i, j)]  # noqa: E731, B023
        step = _solve([[at(i, j) + (1e-9 * scale if i == j else 0) for j in k] for i in k], gap)
        rate = F.greatest(F.lit(0.0), rate - sum(F.col("p")[i] * F.lit(step[i]) for i in k))
        if done % keep == 0:
            rows, rate = C.checkpoint(rows.withColumn("rate", rate)), F.col("rate")
    return best


def mix_to_targets(
    docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    total_tokens: float | None = None, sample_rows: int = SAMPLE_ROWS, markers: int = MARKERS, keyed: bool = False,
) -> DataFrame:
    """One row per document: id, tokens, p_<domain>, rate, copies.

    targets: weight of each domain (any scale). total_tokens: expected tokens of the mixture, those of
    the corpus if None. copies is the rate rounded up or down by a hash of id and text, so that its
    expectation is the rate. Null and empty texts have no tokens and their rate follows from the words
    they lack; equal rows get equal rates. Without labels all posteriors are even. A target that no
    document can serve is met as nearly as the others allow. keyed: with text_key too, for apply_copies.
    """
    names = list(targets)
    base, weight = learn_domains(docs, labels, domain, names, id_col, text_col, sample_rows, markers)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = [C.text_key(F.col("text")).alias("text_key")] if keyed else []
    rows = rows.select("id", text.alias("text"), *key, F.size(_tokens(text)).cast("long").alias("tokens"), F.xxhash64("id", "text").alias("h"))
    rows = C.checkpoint(with_posterior(rows, base, weight).select("id", *(["text_key"] if keyed else []), "tokens", "p", "h"))
    total = total_tokens if total_tokens is not None else float(rows.agg(F.sum("tokens")).first()[0] or 0)
    whole = sum(targets.values())
    out = fit_rates(rows, [total * w / whole for w in targets.values()])
    draw = F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20)
    return out.select(
        F.col("id").alias(id_col),
        *(["text_key"] if keyed else []),
        "tokens",
        *[F.col("p")[i].alias(f"p_{k}") for i, k in enumerate(names)],
        "rate",
        (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long").alias("copies"),
    )


#: The domains of the labels table and the mixture that the query and the pipeline ask for.
TARGETS = {"good_clean": 0.90, "good_toxic": 0.02, "poor_clean": 0.07, "poor_toxic": 0.01}


def label_domain() -> Column:
    """good or poor, and clean or toxic; null where a label is."""
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return F.concat(quality, F.lit("_"), F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean"))


def apply_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each as often as its copies say (0: not at all). mixed: mix_to_targets with keyed=True.

    Rows are told apart by id and text; rows that have both in common have the same copies, and each gets them.
    """
    times = mixed.groupBy(F.col(id_col).alias("id"), F.col("text_key").alias("key")).agg(F.max("copies").alias("n")).where("n > 0").alias("m")
    # whole rows travel in one column, so no name can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), C.text_key(F.col(text_col).cast("string")).alias("key")).alias("r")
    rows = rows.join(times, (F.col("r.key") == F.col("m.key")) & F.col("r.id").eqNullSafe(F.col("m.id")))
    return rows.select("r.row", F.explode(F.sequence(F.lit(1), F.col("m.n").cast("int"))).alias("k")).select("row.*")
