"""Tokens and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of sentences: white space behind a full stop, exclamation or question mark.
SENTENCE_END = r"(?<=[.!?])\s+"
NOISE = r"https?://\S+|(?:^|\s)@\S+"
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Pieces between runs of Unicode white space, none of them empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Sentences in order, without the white space between them; none of an empty text."""
    return F.filter(F.split(text, SENTENCE_END), lambda x: x != "")


def sentence_spans(text: Column, parts: Column) -> Column:
    """Array of (start, end) character offsets of the sentences in the text: running sums of their lengths and the gaps'."""
    start = F.array().cast("array<struct<start:int,end:int>>")
    gaps = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_END), F.lit(0)), F.length))
    sizes = F.filter(F.zip_with(parts, gaps, lambda s, g: F.struct(g.alias("gap"), F.length(s).alias("n"))), lambda x: x["n"].isNotNull())

    def step(done: Column, x: Column) -> Column:
        at = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)) + x["gap"]
        return F.concat(done, F.array(F.struct(at.alias("start"), (at + x["n"]).alias("end"))))

    return F.aggregate(sizes, start, step)


def kept(token: Column, stopwords: list[str]) -> Column:
    """Whether a lower-cased token stays: not all digits, not empty, no stop word."""
    ok = (token != "") & ~token.rlike(r"^\p{Nd}+$")
    return ok & ~token.isin(stopwords) if stopwords else ok


def lemmas_of(sentence: Column, stopwords: list[str]) -> Column:
    """Kept tokens of a sentence: URLs and mentions go first, then marks, digits and stop words."""
    tokens = F.regexp_extract_all(F.lower(F.regexp_replace(sentence, NOISE, " ")), F.lit(WORD), F.lit(0))
    return F.filter(tokens, lambda t: kept(t, stopwords))


def token_to_sentence(sents_lemmas: Column) -> Column:
    """For each token of the flattened sentences, the number of its sentence."""
    return F.flatten(F.transform(sents_lemmas, lambda s, i: F.array_repeat(i, F.size(s))))
