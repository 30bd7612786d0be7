"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm import sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark, sf_dir):
    from freshet.llm.ngram_join import ngram_join

    return ngram_join(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    from freshet.llm.suffix_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op3_resharding(spark, sf_dir):
    from freshet.llm.resharding import by_source, reshard

    return reshard(_read(spark, sf_dir, "documents"), by_source())


def op4_mixing(spark, sf_dir):
    from freshet.llm.mixing import TARGETS, label_domain, mix_to_targets

    return mix_to_targets(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), label_domain(), TARGETS)


def op5_decontamination(spark, sf_dir):
    from freshet.llm.decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark, sf_dir):
    from freshet.llm.secret_scan import secret_scan

    return secret_scan(_read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark, sf_dir):
    from freshet.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op8_sentence_spans(spark, sf_dir):
    from freshet.llm.sentence_spans import remove_repeated_spans

    return remove_repeated_spans(_read(spark, sf_dir, "documents")).drop("kept")


def op9_quality(spark, sf_dir):
    from freshet.llm.quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_personal_data(spark, sf_dir):
    from freshet.llm.pii import find_personal_data

    return find_personal_data(_read(spark, sf_dir, "documents"))


def op11_toxicity(spark, sf_dir):
    from freshet.llm.toxicity import toxicity_scores

    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_hard_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from freshet.llm.hard_negatives import hard_negatives

    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark, sf_dir):
    from freshet.llm.merkle import merkle_manifest

    return merkle_manifest(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op3_resharding, op4_mixing, op5_decontamination, op6_secret_scan, op7_embedding_dedup, op8_sentence_spans, op9_quality, op10_personal_data, op11_toxicity, op12_hard_negatives, op13_merkle_manifest)}
ORACLE = sql.ORACLE
