"""The training-corpus pipeline: reject toxic documents, keep one of each group of near copies, cut out benchmark passages,
mix the sources by weight, and shuffle into shards. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocalith.llm import decontamination, mixing, near_copies, sharding, toxicity
from vocalith.plans.scratch import materialize

SHARDS = 24
#: Rows that a Python worker gets at once, which bounds its memory where texts are long. Stages are lazy, so this setting of the
#: session stays after them.
ARROW_ROWS = 500


def bounded(stage):
    """``stage`` with batches of ``ARROW_ROWS`` rows."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return stage(spark, docs, sf_dir)

    run.__doc__ = stage.__doc__
    return run


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is more likely 0 than above, by a model of the labelled ones among them.

    Null, empty and wordless texts stay; equal rows stay or go together; without labels all stay. No documents: no rows. Texts
    are read whole; columns pass through whatever their names.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of texts with a five-word similarity of 0.8 or more.

    Null, empty and blank texts are one component; null ids come last in theirs; of equal rows one stays. No documents: no
    rows. Texts are compared whole; columns pass through whatever their names.
    """
    return near_copies.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the ten-word windows of the benchmark; those that are mostly benchmark go.

    Null, empty and clean texts stay as they are; equal rows are cut alike; an empty benchmark changes nothing. No documents:
    no rows. Texts are searched whole; columns pass through whatever their names.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each pass over its source, the words of each document that the mix takes.

    Null, empty and blank texts have no words to take; null sources are one source; equal rows are taken one by one. No
    documents: no rows. Texts are cut whole; columns pass through whatever their names, and ``n_chars`` is counted again.
    """
    return mixing.mixed_documents(docs)


def shuffle(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Row number, shard and slot of each document.

    Nulls are values of their own; equal rows get places of their own. No documents: no rows. Columns pass through whatever
    their names, but for these three.
    """
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", bounded(reject_toxic)),
    ("simhash near-dedup", bounded(drop_near_copies)),
    ("benchmark decontamination", bounded(decontaminate)),
    ("mixing", bounded(mix_sources)),
    ("sharding", bounded(shuffle)),
]
#: A fitted model, XXH64 shingles and keyed permutations are beyond DuckDB's SQL: tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
