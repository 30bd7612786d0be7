"""From raw documents to sharded training text: five stages, each by one operator of freshet.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.decontaminate import decontaminate
from freshet.llm.mixing import TARGETS, apply_copies, label_domain, mix_to_targets
from freshet.llm.ngram_join import drop_near_duplicates
from freshet.llm.quality import keep_good
from freshet.llm.resharding import by_source, read_shards, reshard, rewrite_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut stay; null and empty texts are scored like others."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id; null and empty texts are one group."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its fitted rate, rounded by a hash, says; at rate 0 it goes. Equal rows have equal rates."""
    return apply_copies(docs, mix_to_targets(docs, _table(spark, sf_dir, "labels"), label_domain(), TARGETS, keyed=True))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mixture, copies included, with its shard and slot, as read back from the shards that were written.

    The shards are files of their own in the checkpoint folder, which all executors share. Columns shard
    and slot of the rows are replaced. Without rows there are no shards.
    """
    folder = f"{common.checkpoint_folder(spark)}/shards-{uuid.uuid4().hex}"
    if not rewrite_shards(reshard(docs, by_source(), carry=True), folder):
        return docs.drop("shard", "slot").withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).limit(0)
    return read_shards(spark, folder)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the checkpoint folder for the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.checkpoint(docs)
    return docs
