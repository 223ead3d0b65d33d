"""Raw texts to sentences, lemmas and the maps between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lemmas_of, sentence_spans, sentences, token_to_sentence

#: raw, sentences as written, lemmas by sentence and on end, sentence offsets, sentence of each lemma.
COLUMNS = ["doc_id", "raw", "sents_surface", "sents_lemmas", "doc_lemmas", "sent_char_spans", "token_to_sent"]


def load_analyzer(analyze: Callable[[str], list[tuple[str, int, int, list[str]]]]) -> Callable[[DataFrame], DataFrame]:
    """A plug-in: ``analyze`` gives a text's sentences as (surface, start, end, lemmas).

    It is shipped to the Python workers and called there, text by text, so a model
    that is costly to load belongs into a cached function of the caller's module.
    """
    schema = "doc_id long, raw string, sents_surface array<string>, sents_lemmas array<array<string>>, sent_char_spans array<struct<start:int,end:int>>"

    def work(batches):
        import pandas as pd

        for pdf in batches:
            found = [analyze(t) for t in pdf["raw"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "raw": pdf["raw"], "sents_surface": [[s[0] for s in f] for f in found],
                "sents_lemmas": [[list(s[3]) for s in f] for f in found], "sent_char_spans": [[{"start": s[1], "end": s[2]} for s in f] for f in found],
            })

    return lambda raw: raw.mapInPandas(work, schema)


def preprocess_texts(docs: DataFrame, analyzer: Callable[[DataFrame], DataFrame] | None = None, stopwords: Sequence[str] | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to COLUMNS; a null text is an empty one.

    By default sentences end at white space behind . ! or ?, and a lemma is a lower-cased
    run of letters and digits that isn't all digits, nor a stop word, nor part of a URL or
    mention. ``lemmas(surface, lemma)`` maps runs to lemmas before stop words are dropped;
    an ``analyzer`` (see load_analyzer) replaces all but the stop words.
    """
    stop = sorted(set(stopwords or []))
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    if analyzer is not None:
        parts = analyzer(raw)
        if stop:
            parts = parts.withColumn("sents_lemmas", F.transform("sents_lemmas", lambda s: F.filter(s, lambda t: ~t.isin(stop))))
    else:
        parts = raw.withColumn("sents_surface", sentences(F.col("raw")))
        parts = parts.withColumn("sents_lemmas", F.transform("sents_surface", lambda s: lemmas_of(s, [] if lemmas is not None else stop)))
        parts = parts.withColumn("sent_char_spans", sentence_spans(F.col("raw"), F.col("sents_surface")))
        if lemmas is not None:
            parts = _lemmatized(parts, lemmas, stop)
    return parts.select("doc_id", "raw", "sents_surface", "sents_lemmas", F.flatten("sents_lemmas").alias("doc_lemmas"), "sent_char_spans", token_to_sentence(F.col("sents_lemmas")).alias("token_to_sent"))


def _lemmatized(parts: DataFrame, lemmas: DataFrame, stop: list[str]) -> DataFrame:
    flat = parts.select("doc_id", F.posexplode_outer("sents_lemmas").alias("s", "tokens")).select("doc_id", "s", F.posexplode_outer("tokens").alias("i", "t"))
    # one lemma a surface, so that the join keeps one row a token
    table = lemmas.groupBy(F.lower("surface").alias("t")).agg(F.min(F.lower("lemma")).alias("lemma"))
    named = flat.join(table, "t", "left").select("doc_id", "s", "i", F.coalesce("lemma", "t").alias("t"))
    keep = F.col("t").isNotNull() & (F.col("t") != "")
    if stop:
        keep &= ~F.col("t").isin(stop)
    by_sentence = named.groupBy("doc_id", "s").agg(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("i", "t")))), lambda x: x["t"]).alias("l"))
    by_doc = by_sentence.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "l")))), lambda x: x["l"]).alias("sents_lemmas"))
    return parts.drop("sents_lemmas").join(by_doc, "doc_id")


def build_docs_from_preprocessed(pre_docs: DataFrame) -> DataFrame:
    """``doc_id, tokens``: the lemmas on end."""
    return pre_docs.select("doc_id", F.col("doc_lemmas").alias("tokens"))
