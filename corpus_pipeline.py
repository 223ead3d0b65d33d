"""From raw documents to token ids, in stages; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiltfield.llm import bpe, common, langid, mixing, ngramjoin, substrings

_before: list[str] = []


def _stage(function):
    """Frees the shared tables of the stage before, whose rows have been written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _before)
        known = set(common._OPEN)
        out = function(docs)
        _before[:] = [p for p in common._OPEN if p not in known]
        return out

    run_stage.__name__, run_stage.__doc__ = function.__name__, function.__doc__
    return run_stage


@_stage
def language_id(docs: DataFrame) -> DataFrame:
    """Documents whose language is identified; those without words or a clear lead go."""
    return langid.keep_identified(docs)


@_stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngramjoin.drop_near_duplicates(docs)


@_stage
def substring_dedup(docs: DataFrame) -> DataFrame:
    """Documents without the later occurrences of repeated passages."""
    return substrings.remove_repeats(docs)


@_stage
def mix(docs: DataFrame) -> DataFrame:
    """Documents in shuffled shards, each with the natural shares of the sources; a shard is a file."""
    return mixing.mixed_documents(docs)


@_stage
def tokenize(docs: DataFrame) -> DataFrame:
    """Token ids of each document, checked by decoding them, with its shard and position there."""
    return bpe.encode_documents(mixing.placed(docs), keep=("shard", "position"))


#: Rows of a batch between Spark and its Python workers: whole texts, and a worker and its executor hold several batches.
BATCH_ROWS = 2000
STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("mixing", mix), ("bpe", tokenize)]

#: The mixing stage draws at random, which SQL can't repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.shared_dir(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        for i, (name, function) in enumerate(STAGES):
            docs = function(spark, docs, sf_dir)
            docs.write.option("compression", "zstd").parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                common._remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    finally:
        spark.conf.set(setting, before)
    return docs
