"""Queries of the training-data operators and, where SQL can say it, what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, lmscore, mixing, ngramjoin, substrings, topk, toxicity, urlfilter


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark, sf_dir):
    return lmscore.lm_score(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint(_table(spark, sf_dir, "documents"))


def op4_topk(spark, sf_dir):
    """Queries are the rows whose id is divisible by topk.EVERY, items are all rows."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), queries=F.col("id") % topk.EVERY == 0)


def op5_bpe(spark, sf_dir):
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substrings(spark, sf_dir):
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op9_ngram_join(spark, sf_dir):
    return ngramjoin.jaccard_join(_table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix_rows(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_language_id, op3_fingerprints, op4_topk, op5_bpe, op6_toxicity, op7_substrings, op8_url_filter, op9_ngram_join, op10_mixing)}
ORACLE_SQL = {
    "op2_language_id": langid.ORACLE,
    "op4_topk": topk.ORACLE,
    "op7_substrings": substrings.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op9_ngram_join": ngramjoin.ORACLE,
}
