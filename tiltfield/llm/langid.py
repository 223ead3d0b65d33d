"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each language that the model is fitted on, by the least md5 of their id.
TRAIN_ROWS = 1000
#: Lengths of the n-grams.
GRAMS = (4, 3, 2, 1)
#: A document is accepted if its best language leads the next by so much a word ...
MIN_MARGIN = 0.02
#: ... and so large a share of its words is known by at least one letter.
MIN_SCORED = 0.5
HALF = 0.5
_LETTERS = regex.compile(r"\p{L}+")
#: ASCII characters that are no letters.
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalpha())


@dataclass(frozen=True)
class Model:
    """Log probabilities of words and n-grams, one value a language."""

    langs: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: dict[int, dict[str, tuple[float, ...]]]

    def word(self, word: str) -> tuple[float, ...] | None:
        """A known word's own values; else the mean over the longest known n-grams; else None."""
        if (known := self.words.get(word)) is not None:
            return known
        padded = f" {word} "
        for n in GRAMS:
            table = self.grams[n]
            found = list(filter(None, [table.get(padded[i : i + n]) for i in range(len(padded) - n + 1)]))
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found))
        return None

    @functools.cached_property
    def seed(self) -> tuple[dict[str, int], np.ndarray]:
        """Number of each word of the model, and their rows of _Scorer; made once a worker."""
        rows = np.ones((len(self.words), 3 + len(self.langs)))
        rows[:, 2] = [self.known(w) for w in self.words]
        rows[:, 3:] = np.array(list(self.words.values())).reshape(len(self.words), len(self.langs))
        return {w: i for i, w in enumerate(self.words)}, rows

    def known(self, word: str) -> bool:
        """Whether one of the word's letters is in the model; its padding alone isn't enough."""
        return not self.grams[1].keys().isdisjoint(word)


def _counts(sample: DataFrame) -> DataFrame:
    """``lang, g, w, n``: how often a word (g = 0) or an n-gram of g characters occurs in a language."""

    def work(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                words.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
        for lang, count in words.items():
            tables = {0: count} | {g: Counter() for g in GRAMS}
            for word, n in count.items():
                padded = f" {word} "
                for g in GRAMS:
                    table = tables[g]
                    for i in range(len(padded) - g + 1):
                        table[padded[i : i + g]] += n
            for g, table in tables.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table)), pa.array([g] * len(table), pa.int32()), pa.array(list(table)), pa.array(list(table.values()), pa.int64())], names=["lang", "g", "w", "n"])

    parts = sample.select("lang", "text").mapInArrow(work, "lang string, g int, w string, n long")
    return parts.groupBy("lang", "g", "w").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` rows of each language with ``doc_id``, ``text`` and ``lang``, whole texts.

    All words and n-grams of these rows are in the model; nothing else bounds what reaches
    the driver. Rows with a null or empty lang or text teach nothing; without any, no word
    is known.
    """
    rows = labelled.where("text <> '' and lang <> ''").select("doc_id", "text", "lang")
    # only names are sorted; the texts of the few that are chosen are joined to them
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "t")
    named = rows.select(F.col("doc_id"), F.md5("text").alias("t"), F.col("lang")).withColumn("r", F.row_number().over(order))
    chosen = named.where(F.col("r") <= train_rows).drop("r").distinct()
    a, b = rows.withColumn("t", F.md5("text")).alias("a"), F.broadcast(chosen).alias("b")
    sample = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.t = b.t and a.lang = b.lang"), "left_semi")
    kept = _counts(sample).select("lang", "g", "w", "n").toArrow()
    columns = [kept.column(c).to_pylist() for c in ("lang", "g", "w", "n")]
    langs = tuple(sorted(set(columns[0])))
    at = {lang: i for i, lang in enumerate(langs)}
    counts: dict[int, dict[str, list[int]]] = {g: {} for g in (0, *GRAMS)}
    for lang, g, w, n in zip(*columns):
        counts[g].setdefault(w, [0] * len(langs))[at[lang]] = n

    def logs(table: dict[str, list[int]]) -> dict[str, tuple[float, ...]]:
        totals = [sum(v[i] for v in table.values()) + HALF * len(table) for i in range(len(langs))]
        # words with the same counts share their values, which keeps the model small
        known: dict[tuple[int, ...], tuple[float, ...]] = {}
        for v in table.values():
            if tuple(v) not in known:
                known[tuple(v)] = tuple(float(np.log((x + HALF) / total)) for x, total in zip(v, totals))
        return {w: known[tuple(v)] for w, v in table.items()}

    return Model(langs, logs(counts[0]), {g: logs(counts[g]) for g in GRAMS})


class _Scorer(dict):
    """White-space token -> row of [words, scored words, words known by a letter, score of each language].

    The model's words are there from the start; ``limit`` tokens besides them are held at a time.
    """

    def __init__(self, model: Model, limit: int = 100_000):
        self.known, rows = model.seed
        super().__init__(self.known)
        self.model, self.limit, self.most, self.none = model, limit, len(self.known) + limit, (0,) * len(model.langs)
        self.rows, self.used = np.concatenate([rows, np.zeros((limit, rows.shape[1]))]), len(rows)

    def clear(self):
        super().clear()
        self.update(self.known)
        self.used = len(self.known)

    def __missing__(self, token):
        low = token.lower()
        # what is cut off holds no letter, so a word of the model is the token's only word
        if (i := self.known.get(low.strip(_MARKS))) is None:
            n = scored = known = 0
            score = None
            for word in _LETTERS.findall(low):
                n += 1
                if (v := self.model.word(word)) is not None:
                    scored += 1
                    known += self.model.known(word)
                    score = v if score is None else [a + b for a, b in zip(score, v)]
            i = self.used
            self.used += 1
            self.rows[i] = (n, scored, known, *(score or self.none))
        self[token] = i
        return i

    def text(self, text: str) -> np.ndarray:
        total = np.zeros(self.rows.shape[1])
        tokens = text.split()
        step = self.limit // 2  # a longer text goes part by part; the cache may be emptied between
        for s in range(0, len(tokens), step):
            part = tokens[s : s + step]
            if len(self) + len(part) > self.most:
                self.clear()
            total += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0)
        return total


def identify(spark: SparkSession, text: Column, model: Model) -> Column:
    """Struct ``lang, margin, n_words, accepted`` of a text column, with the rows in place.

    ``lang`` has the greatest mean log frequency a scored word, on a tie the first by name;
    ``margin`` is its lead over the next (0 if there is one language only). Accepted: at
    least one scored word, MIN_SCORED of all words known by at least one letter (the space
    around a word is known in every language), and a lead of MIN_MARGIN. A null, empty or letterless text has lang 'und', margin 0, and isn't accepted. Texts are
    read whole. A pandas UDF, no shuffle.
    """
    spark_model = spark.sparkContext.broadcast(model)

    def work(batches):
        m = spark_model.value
        scorer = _Scorer(m)
        for texts in batches:
            out = [_verdict(scorer.text(t) if t else None, m) for t in texts]
            del texts
            yield pd.DataFrame(out, columns=["lang", "margin", "n_words", "accepted"])
            common.give_back()
        del scorer
        common.give_back()

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(work, "lang string, margin double, n_words long, accepted boolean")(text)


def _verdict(total: np.ndarray | None, m: Model) -> tuple[str, float, int, bool]:
    if total is None or total[1] == 0:
        return "und", 0.0, int(total[0]) if total is not None else 0, False
    means = total[3:] / total[1]
    order = np.argsort(-means, kind="stable")
    margin = float(means[order[0]] - means[order[1]]) if len(order) > 1 else 0.0
    margin = round(margin, 4)
    ok = (len(order) == 1 or margin >= MIN_MARGIN) and total[2] >= MIN_SCORED * total[0]
    return m.langs[order[0]], margin, int(total[0]), bool(ok)


def language_id(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, pred_lang, margin, n_words, accepted`` for each row of ``docs``; see ``identify``.

    Without a model, one is fitted on ``docs`` itself. Null ids, repeated rows and other
    columns are left as they are; an empty table gives an empty result.
    """
    model = model or fit(docs)
    return docs.select("doc_id", identify(docs.sparkSession, F.col("text"), model).alias("v")).select("doc_id", F.col("v.lang").alias("pred_lang"), "v.margin", "v.n_words", "v.accepted")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns."""
    model = model or fit(docs)
    return docs.where(identify(docs.sparkSession, docs["text"], model)["accepted"])


ORACLE = f"""
with train as (
  select doc_id, text, lang from documents where text <> '' and lang <> ''
  qualify row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id, md5(text)) <= {TRAIN_ROWS}),
tw as (
  select lang, w, count(*) n from (select lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) w from train) group by all),
tg as (
  select lang, g, w, sum(n) n from (
    select lang, g, unnest(list_transform(range(1, length(p) - g + 2), lambda i: substr(p, i, g))) w, n
    from (select lang, ' ' || w || ' ' p, n from tw), (select unnest([{', '.join(map(str, GRAMS))}]) g) where length(p) >= g) group by all),
kept as (select lang, 0 g, w, n from tw union all by name select lang, g, w, n from tg),
langs as (select distinct lang from kept),
totals as (
  select l.lang, s.g, coalesce(sum(k.n), 0) + {HALF} * any_value(s.v) total
  from langs l cross join (select g, count(distinct w) v from kept group by g) s
  left join kept k on k.lang = l.lang and k.g = s.g group by l.lang, s.g),
keys as (select distinct g, w from kept),
model as (
  select t.lang, k.g, k.w, ln((coalesce(c.n, 0) + {HALF}) / t.total) v
  from keys k join totals t on t.g = k.g left join kept c on c.g = k.g and c.w = k.w and c.lang = t.lang),
tokens as (select doc_id, w, count(*) n from (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) w from documents) group by all),
types as (select distinct w from tokens),
direct as (select t.w, m.lang, m.v from types t join model m on m.g = 0 and m.w = t.w),
parts as (
  select w, g, unnest(list_transform(range(1, length(w) + 4 - g), lambda i: substr(' ' || w || ' ', i, g))) q
  from types, (select unnest([{', '.join(map(str, GRAMS))}]) g)
  where length(w) + 2 >= g and w not in (select w from keys where g = 0)),
known as (select p.w, p.g, m.lang, avg(m.v) v from parts p join model m on m.g = p.g and m.w = p.q group by all),
backed as (select w, lang, v from known qualify g = max(g) over (partition by w)),
scores as (select * from direct union all select w, lang, v from backed),
doc_scores as (select t.doc_id, s.lang, sum(t.n) scored, sum(t.n * s.v) / sum(t.n) m from tokens t join scores s using (w) group by all),
best as (
  select doc_id, any_value(scored) scored, arg_max(lang, m) lang, max(m) - coalesce(list_sort(list(m), 'DESC')[2], max(m)) margin, count(*) k
  from doc_scores group by doc_id),
letters as (select list(w) every from keys where g = 1),
lettered as (select w, list_has_any(string_split(w, ''), every) known from types, letters),
sizes as (select doc_id, sum(n) n_words, sum(n) filter (where known) n_known from tokens join lettered using (w) group by doc_id)
select d.doc_id, coalesce(b.lang, 'und') pred_lang, coalesce(round(b.margin, 4), 0.0) margin,
  cast(coalesce(s.n_words, 0) as bigint) n_words,
  coalesce((b.k = 1 or round(b.margin, 4) >= {MIN_MARGIN}) and coalesce(s.n_known, 0) >= {MIN_SCORED} * s.n_words, false) accepted
from documents d left join best b using (doc_id) left join sizes s using (doc_id)"""
