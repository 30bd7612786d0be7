"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, for every operator and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import decontaminate, embedding_dedup, mixing, ngram_join, pii, quality, resharding, secret_scan, sentence_spans, suffix_dedup

LONG = " ".join(f"word{k % 977} {k}" for k in range(50_000))
TEXTS = [(1, None), (2, ""), (None, "a short text"), (None, "a short text"), (3, "tie one two three four five"), (3, "tie one two three four five"), (4, LONG), (5, LONG + " end"), (None, None)]
CLASH = ("id", "key", "row", "n", "shard", "slot", "_key", "_held", "_kept", "_n", "_id", "text_key", "grp", "k", "lang")


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (2, 0, 1), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "an item that no text holds, with an answer. Yes indeed."), (3, "tie one two three four five")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, labels, items: ngram_join.ngram_join(d),
    "op2": lambda d, labels, items: suffix_dedup.remove_repeats(d),
    "op3": lambda d, labels, items: resharding.reshard(d, resharding.by_source()).drop("slot", "shard", "moved"),
    "op4": lambda d, labels, items: mixing.mix_to_targets(d, labels, mixing.label_domain(), mixing.TARGETS),
    "op5": lambda d, labels, items: decontaminate.contaminated(d, items),
    "op6": lambda d, labels, items: secret_scan.secret_scan(d),
    "op8": lambda d, labels, items: sentence_spans.remove_repeated_spans(d),
    "op9": lambda d, labels, items: quality.quality_scores(d, labels),
    "op10": lambda d, labels, items: pii.find_personal_data(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(plain, clashing, labels, items, name):
    rows = OPERATORS[name](plain, labels, items).collect()
    assert Counter(map(str, rows)) == Counter(map(str, OPERATORS[name](clashing, labels, items).collect()))
    assert len(rows) == (2 if name == "op5" else len(TEXTS))
    by = {(r["doc_id"], i): r for i, r in enumerate(rows)}
    got = lambda i: [r for (k, _), r in by.items() if k == i]
    if name == "op1":
        assert [(r["n_copies"], r["n_text_links"], r["group_id"]) for r in got(4)] == [(1, 1, 4)] and got(5)[0]["group_id"] == 4
        assert {(r["n_copies"], r["n_links"]) for r in got(3)} == {(2, 1)} and {(r["n_copies"]) for r in got(1) + got(2)} == {3}
    elif name == "op2":
        assert got(4)[0]["n_removed"] == len(LONG) and got(5)[0]["n_removed"] == len(LONG) and got(1)[0]["n_bytes"] == 0
    elif name == "op3":
        assert got(1)[0]["size"] == 16 and got(4)[0]["size"] == len(LONG) + 16
    elif name == "op4":
        assert got(1)[0]["tokens"] == 0 and got(4)[0]["tokens"] == 100_000 and got(3)[0] == got(3)[1]
    elif name == "op5":
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(3, 3)}
    elif name == "op8":
        assert got(4)[0]["n_removed"] == 0 and got(2)[0]["kept"] == ""
    elif name == "op9":
        assert all(0 <= r["score"] <= 1 for r in rows) and got(3)[0] == got(3)[1]
    else:
        assert all(r["spans"] == "" for r in got(1) + got(2) + got(3))


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(plain, labels, items, name):
    assert OPERATORS[name](plain.limit(0), labels.limit(0), items.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, None], "a"), (5, [nan, 1.0], "a"), (6, [inf, 1.0], "a"), (7, [0.0, 0.0], "a"), (8, None, "a"), (9, [], "a"), (10, [1.0, 0.0], None)]
    rows += [(11, [2.0], "a,1.0"), (12, [1.0, 2.0], "a"), (13, [0.5, 1.0], "a"), (None, [1.0, 0.0], "a")]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    assert found == alone | {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, False), 12: (1, 12, True), 13: (1, 12, False)}
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


@pytest.fixture(scope="module")
def folder(spark, labels, items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, clashing, folder):
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in d.collect())
    n = len(LONG)
    near = stages["near_duplicates"](spark, clashing, folder)
    assert near.columns == clashing.columns and ids(near) == [(0, 12), (1, 0), (3, 27), (4, n)]
    clean = stages["decontamination"](spark, clashing, folder)
    assert clean.columns == clashing.columns and ids(clean) == [(0, 0), (0, 12), (0, 12), (1, 0), (2, 0), (4, n), (5, n + 4)]
    good = stages["quality"](spark, clashing, folder)
    assert good.columns == clashing.columns and set(ids(good)) <= set(ids(clashing))
    mixed = stages["mixing"](spark, clashing, folder)
    assert mixed.columns == clashing.columns and set(ids(mixed)) <= set(ids(clashing))
    shards = stages["sharding"](spark, clashing, folder)
    assert sorted(shards.columns) == sorted(clashing.columns) and ids(shards) == ids(clashing)
    assert {r["lang"] for r in shards.collect()} == {"own lang"} and [r["slot"] for r in shards.collect()] == [0] * len(TEXTS)
    for name, stage in stages.items():
        assert stage(spark, clashing.limit(0), folder).count() == 0, name
