"""Substring dedup: Rabin-Karp hashes of every window of WINDOW tokens, counted in Spark.

A window is repeated if its hash occurs twice in the corpus; each of its occurrences but
the first (by id, then text) is removed, and touching windows merge into maximal
intervals. Two passes keep the shuffle small without losing a window: windows that are
equal have the same least hash of an inner run of GRAM tokens, so a window whose least run
occurs once in the corpus occurs once itself and its hash need not be sent. First the
least runs are counted, then the hashes of all windows whose least run is repeated. Windows
are told apart by 96 bits. Those whose least run is in more than HOT documents are
compared within SALTS groups first, so that no task sorts all occurrences of one passage.

A row is named by 64 bits of its content and its id.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashCache, arrow_slices, give_back, materialize, mix, row_key, shared_dir
from .urlfilter import bloom

#: Tokens of a window; tokens of the inner run that stands for it in the first pass.
WINDOW, GRAM = 50, 25
#: Documents with one least run from which its windows are salted; salts.
HOT, SALTS = 50_000, 256
#: Characters of text that a task works on at once; token hashes that it keeps.
SLICE, CACHE = 1 << 20, 100_000
_BASE = 0x9E3779B97F4A7C15
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as texts need them."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) < n:
            size = 2 * n
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return cls.up, cls.down


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` tokens (uint64 token hashes), mixed at the end."""
    n = len(tokens)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _Powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _other(tokens: np.ndarray) -> np.ndarray:
    """Token hashes that have nothing to do with the given ones, for a second window hash."""
    return mix(tokens ^ np.uint64(0xA24BAED4963EE407))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by two scans over blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    padded = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class _Tokens:
    """Token hashes of texts; tokens are runs of characters other than ASCII white space."""

    def __init__(self):
        self.cache = HashCache(CACHE)

    def __call__(self, text: str) -> np.ndarray:
        parts = text.encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.cache.__getitem__, parts), np.uint64, len(parts))


def _first_pass(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, doc_id, g, n``: the distinct least runs of each document; n is 2 if the document repeats the run."""

    def work(batches):
        tokens = _Tokens()
        for batch in batches:
            for a, b in arrow_slices(batch.column(2), SLICE):
                runs, counts = [], []
                for t in batch.column(2)[a:b].to_pylist():
                    every = rolling(tokens(t), gram)
                    low = np.unique(least(every, window - gram + 1))
                    every.sort()
                    runs.append(low)
                    counts.append(np.minimum(2, np.searchsorted(every, low, "right") - np.searchsorted(every, low)))
                index = pa.array(np.repeat(np.arange(a, b), [len(r) for r in runs]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.concatenate(runs).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int8))],
                    names=["key", "doc_id", "g", "n"],
                )
        del tokens
        give_back()

    return docs.mapInArrow(work, f"key long, doc_id {_kind(docs)}, g long, n byte")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _second_pass(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, doc_id, pos, h, x, salt``: every window whose least run is among the row's ``runs``.

    ``h`` and ``x`` are its hashes, ``salt`` is -1 unless the run is among those in ``hot``.
    """

    def work(batches):
        tokens = _Tokens()
        for batch in batches:
            keys, texts, runs, hot = batch.column(0).to_numpy(), batch.column(2), batch.column(3), batch.column(4)
            for a, b in arrow_slices(texts, SLICE):
                out = []
                for i in range(a, b):
                    ids = tokens(texts[i].as_py())
                    low = least(rolling(ids, gram), window - gram + 1)
                    at = np.flatnonzero(_among(low, runs[i]))
                    salt = np.where(_among(low[at], hot[i]), keys[i] % SALTS, -1)
                    out.append((at, rolling(ids, window)[at], rolling(_other(ids), window)[at] >> np.uint64(32), salt))
                index = pa.array(np.repeat(np.arange(a, b), [len(x[0]) for x in out]))
                at, h, x, salt = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), batch.column(1).take(index), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(x.astype(np.uint32).view(np.int32)), pa.array(salt.astype(np.int16))],
                    names=["key", "doc_id", "pos", "h", "x", "salt"],
                )
        del tokens
        give_back()

    return docs.mapInArrow(work, f"key long, doc_id {_kind(docs)}, pos int, h long, x int, salt short")


def _among(values: np.ndarray, known: pa.ListScalar) -> np.ndarray:
    known = np.sort(known.values.to_numpy().view(np.uint64))
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _merge(marked: DataFrame, window: int) -> DataFrame:
    """Rows ``key, doc_id, pos, removed``, sorted in that order but for pos last -> ``key, doc_id, start, stop, removed``."""

    def work(batches):
        held = None  # the interval that the next batch may go on with: its row, start, stop
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch] if held is None else [held[0], batch]).combine_chunks().to_batches()[0]
            key, pos, flag = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            if held is not None:
                pos[0] = held[2] - window
            name = pc.rank(batch.column(1), tiebreaker="dense").to_numpy() if len(key) else key
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (flag[1:] != flag[:-1]) | (pos[1:] > pos[:-1] + window)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(key)) - 1
            start, stop = pos[first].copy(), pos[last] + window
            if held is not None:
                start[0] = held[1]
            held = (batch.slice(int(first[-1]), 1), start[-1], stop[-1])
            if len(first) > 1:
                yield _intervals(batch.take(pa.array(first[:-1])), start[:-1], stop[:-1])
        if held is not None:
            yield _intervals(held[0], np.array([held[1]]), np.array([held[2]]))

    return marked.mapInArrow(work, f"key long, doc_id {_kind(marked)}, start int, stop int, removed boolean")


def _intervals(rows: pa.RecordBatch, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [rows.column(0), rows.column(1), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pc.cast(rows.column(3), pa.bool_())],
        names=["key", "doc_id", "start", "stop", "removed"],
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(row_key("doc_id", "text").alias("key"), "doc_id", "text")


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` with ``right``'s other columns, on key and id; null ids are equal."""
    named = right.withColumnsRenamed({"key": "_key", "doc_id": "_doc_id"})
    on = (left["key"] == named["_key"]) & left["doc_id"].eqNullSafe(named["_doc_id"])
    return left.join(named, on, how).drop("_key", "_doc_id")


def intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``key, doc_id, start, stop, removed``: maximal runs of repeated windows, of token numbers."""
    gram, folder = min(gram, window), shared_dir(docs.sparkSession)
    texts = _keyed(docs)
    runs = materialize(_first_pass(texts, window, gram), folder, "runs")
    again = materialize(runs.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g", (F.col("n") > hot).alias("hot")), folder, "again")
    wanted = runs.select("key", "doc_id", "g").join(again, "g").groupBy("key", "doc_id").agg(F.collect_set("g").alias("runs"), F.collect_set(F.when(F.col("hot"), F.col("g"))).alias("hot"))
    wanted = materialize(wanted, folder, "wanted")
    # texts without a repeated run, but for a few that the filter takes in falsely, stay out of the shuffle
    names = [F.col("key").alias("a"), F.xxhash64("key").alias("b")]
    level = bloom(wanted.select(*names).distinct(), wanted.count(), 0.02, f"{folder}/held")
    texts = texts.where(level.column(*names))
    # one row for each name: a row that is repeated in full is one document
    held = _same(texts, wanted).dropDuplicates(["key", "doc_id"]).select("key", "doc_id", "text", "runs", "hot")
    windows = _second_pass(held, window, gram)

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        same = Window.partitionBy("h", "x", *by).orderBy("doc_id", "key", "pos")
        more = F.lead("pos").over(same).isNotNull()
        return rows.withColumn("r", F.row_number().over(same)).withColumn("two", more | (F.col("r") > 1))

    first = ranked(windows, "salt")
    marked = first.where(F.when(F.col("salt") < 0, F.col("two")).otherwise(F.col("r") > 1)).select("key", "doc_id", "pos", (F.col("r") > 1).cast("byte").alias("removed"))
    if again.where("hot").limit(1).count():
        # of a hot passage, the first occurrences of the salts are compared once more
        lead = first.where("salt >= 0 and r = 1").select("key", "doc_id", "pos", "h", "x", F.col("two").alias("had"))
        lead = ranked(lead).where("two or had").select("key", "doc_id", "pos", (F.col("r") > 1).cast("byte").alias("removed"))
        marked = marked.unionByName(lead)
    return _merge(marked.repartition("key").sortWithinPartitions("key", "doc_id", "removed", "pos"), window)


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, start_token, end_token, n_tokens, removed``: maximal repeated passages of the corpus.

    A passage is a run of overlapping or touching windows that occur at least twice in the
    corpus, in other documents or in the same. ``removed``: the windows' later occurrences,
    which removal takes out; not ``removed``: their first ones, by (doc_id, nulls first, text hash,
    position), which stay. ``end_token`` is exclusive. Null and empty texts and texts
    shorter than the window have no rows; a row repeated in full counts as one document;
    rows with a null id are documents like others. Other columns are ignored; an empty
    table gives an empty result.
    """
    found = intervals(docs, window, gram)
    return found.select("doc_id", F.col("start").alias("start_token"), F.col("stop").alias("end_token"), (F.col("stop") - F.col("start")).alias("n_tokens"), "removed")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the tokens of the spans; a gap closes to its leading white space."""
    ends = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        start, stop = ends[a][0], ends[b - 1][1]
        if start > at:
            out.append(text[at:start])
        at = max(at, stop + 1 if stop < len(text) else stop)
    out.append(text[at:])
    return "".join(out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut from ``text``.

    ``n_chars``, if there, is counted again where the text changed. No row is dropped:
    a text that was all repeats becomes what is left of it, maybe empty. All columns stay.
    """
    spans = intervals(docs, window, gram).where("removed").groupBy("key", "doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    @F.pandas_udf("string")
    def without(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([cut(t, list(zip(a, b))) if a is not None and len(a) else t for t, a, b in zip(text, starts, stops)], index=text.index)

    rows = _same(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key("doc_id", "text").alias("key"), "doc_id"), spans, "left")
    text = F.when(F.col("spans").isNotNull(), F.col("new")).otherwise(F.col("row.text"))
    rows = rows.withColumn("new", without(F.when(F.col("spans").isNotNull(), F.col("row.text")), "spans.start", "spans.stop"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("spans").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return rows.select(*out)


ORACLE = f"""
with t as (
  select doc_id, text, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') k
  from (select distinct doc_id, text from documents where text is not null)),
w as (
  select doc_id, text, pos, md5(array_to_string(k[pos + 1 : pos + {WINDOW}], ' ')) h
  from (select *, unnest(range(0, len(k) - {WINDOW} + 1)) pos from t where len(k) >= {WINDOW})),
m as (
  select doc_id, text, pos, row_number() over (partition by h order by doc_id nulls first, pos) > 1 removed
  from w qualify count(*) over (partition by h) > 1),
s as (select *, case when pos > lag(pos) over (partition by doc_id, text, removed order by pos) + {WINDOW} then 1 else 0 end new from m),
i as (select *, sum(new) over (partition by doc_id, text, removed order by pos) g from s)
select doc_id, cast(min(pos) as integer) start_token, cast(max(pos) + {WINDOW} as integer) end_token,
  cast(max(pos) + {WINDOW} - min(pos) as integer) n_tokens, removed
from i group by doc_id, text, removed, g"""
