"""From raw documents to training shards, stage by stage.

Each stage takes what its predecessor kept, as a table that has been written and read again, and
returns the columns of ``documents``; the last one returns the place of each document in its shard.
Stages run one after the other: each first deletes the intermediate tables of the one before, whose
result is stored by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from scrubline.storage import Scratch, write_table

#: SQL can not express the trained score, the hashed order of the mix or the flow.
ORACLE_SQL = None

_left: list[Scratch] = []


def _stage(function: Callable) -> Callable:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().release(spark)
        with Scratch() as scratch:
            kept = function(spark, docs, sf_dir)
        _left.append(scratch)
        return kept

    run_stage.__doc__ = function.__doc__
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_join.one_of_each(docs)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.whole_documents(docs)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in sixteen shards of near equal bytes."""
    return sharding.reshard(docs).select(
        "doc_id", "lang", "source", "n_chars", sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "old_shard", "shard", F.col("slot").cast("long").alias("slot"),
    )


STAGES = [
    ("toxicity", drop_toxic), ("ngram_join", drop_copies), ("decontaminate", drop_benchmark),
    ("mix_sources", mix), ("reshard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        with Scratch() as stored:
            docs = write_table(kept, "stage")
        if before is not None:
            before.release(spark)
        before = stored
    return docs
