"""Language-model scoring with an Elias-Fano trigram trie that is built from the corpus.

Model: interpolated absolute discounting over raw counts,
  p(w)     = c(w) / N, and 1 / N for a word that the corpus holds once or never,
  p(w|v)   = max(c(vw) - D, 0) / c(v) + b(v) p(w),
  p(w|uv)  = max(c(uvw) - D, 0) / c(uv) + b(uv) p(w|v),
where b gives back just what the kept followers leave. Every word, bigram and trigram of
the corpus is counted; those seen MIN_COUNT times have nodes, the others' mass backs off. A
document's first word follows a start mark; words that the corpus holds once end a context.

Trie: a word's id is its place among sorted hashes (memory-mapped, a searched directory).
Level 2 holds followers w of v, level 3 followers of (u, v): there a word is named by its
place among the followers of v alone, so level 3 holds small context-relative numbers. On both
levels a node's children are a range given by an Elias-Fano sequence of pointers, and their
names, raised by the last value of the range before, form one Elias-Fano sequence in
which a child is found by successor search. Discounted probabilities and back-off weights
are logarithms quantised to a byte. Levels are cut into shards of about SHARD_TOKENS tokens,
files in the shared folder that every task maps.

Building takes one pass for each order. A task counts its n-grams in sorted arrays and sends
a shard's part as one compressed delta-coded blob; trigrams are sent only where both
bigrams have nodes, as pairs (node, relative name), looked up in the level below.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_blob, put_blob, shared_dir, slices, word_hashes
from .eliasfano import EliasFano, pack, unpack

MIN_COUNT, DISCOUNT = 2, 0.75
#: Tokens that a shard aims at; n-grams that a task counts at once.
SHARD_TOKENS, BUFFER = 4_000_000, 2_000_000
#: Shards that a task keeps open.
MOST_OPEN = 4096
#: ln of the least number that a byte can say; 255 steps up to 0.
LEAST = -20.0
_LOW = np.uint64(0xFFFFFFFF)


def quantise(x: np.ndarray) -> np.ndarray:
    """Probabilities to bytes: 1-255 spread evenly over logarithms, 0 for none."""
    with np.errstate(divide="ignore"):
        q = np.rint((np.log(x) - LEAST) / -LEAST * 254) + 1
    return np.where(x > 0, np.clip(q, 1, 255), 0).astype(np.uint8)


#: The number that each byte says.
VALUE = np.concatenate([[0.0], np.exp(LEAST * (1 - np.arange(255) / 254))])


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    delta = np.diff(keys, prepend=np.uint64(0))
    planes = [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in (delta, counts.astype(np.uint32))]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    delta = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(delta, dtype=np.uint64), counts


@dataclass
class Trie:
    """What every task needs to find the files; as small as the number of shards."""

    folder: str
    tokens: int = 0
    documents: int = 0
    words: int = 0  # ids; the next one is the start mark
    parts: list = field(default_factory=list)  # vocabulary: first hash, first id, name
    bounds: np.ndarray = None  # first key of each shard: id << 32 | follower
    nodes: np.ndarray = None  # first node of each shard of level 2
    split: dict = field(default_factory=dict)  # words whose followers span shards: (back-off, first node)
    shards2: frozenset = frozenset()
    shards3: frozenset = frozenset()

    @property
    def start(self) -> int:
        return self.words


class Reader:
    """Open files of a trie in one task."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.first_hash = np.array([p[0] for p in trie.parts], np.int64)
        self.first_id = np.array([p[1] for p in trie.parts], np.int64)
        self.vocab = [unpack(get_blob(f"{trie.folder}/{p[2]}")) for p in trie.parts]
        self.level: dict = {}
        words = sorted(trie.split)
        self.split_word = np.array(words, np.int64)
        self.split_bow = np.array([trie.split[w][0] for w in words])
        self.split_node = np.array([trie.split[w][1] for w in words], np.int64)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes (int64), -1 for words without a node."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.first_hash):
            return out
        part = np.searchsorted(self.first_hash, hashes, "right") - 1
        for p in np.unique(part[part >= 0]):
            at = np.flatnonzero(part == p)
            table = self.vocab[p]["hash"]
            k = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
            out[at] = np.where(table[k] == hashes[at], self.first_id[p] + k, -1)
        return out

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        """How often known words (or the start mark) occur."""
        out = np.full(len(ids), self.trie.documents, np.int64)
        part = np.searchsorted(self.first_id, ids, "right") - 1
        for p in np.unique(part):
            at = np.flatnonzero((part == p) & (ids < self.trie.words))
            out[at] = self.vocab[p]["count"][ids[at] - self.first_id[p]]
        return out

    def _open(self, level: int, shard: int):
        key = level, shard
        if key not in self.level:
            if len(self.level) >= MOST_OPEN:  # a process may hold only so many maps
                self.level.pop(next(iter(self.level)))
            names = {2: self.trie.shards2, 3: self.trie.shards3}[level]
            if shard not in names:
                self.level[key] = None
            else:
                parts = unpack(get_blob(f"{self.trie.folder}/level{level}/{shard}"))
                self.level[key] = (parts, EliasFano(parts, "ptr"), EliasFano(parts, "val"))
        return self.level[key]

    def _children(self, opened, parent, name):
        """(place or -1) of each parent's child of that name, and the parents' first places; equal parents lie together."""
        _, ptr, val = opened
        fresh = np.ones(len(parent), bool)
        np.not_equal(parent[1:], parent[:-1], out=fresh[1:])
        own, at = parent[fresh], np.cumsum(fresh) - 1
        a, b = ptr.get(own), ptr.get(own + 1)
        base = np.where(a > 0, val.get(np.maximum(a - 1, 0)) if val.n else 0, 0)
        first = a[at]
        return val.find(name + base[at], first, b[at]), first

    def bigrams(self, v: np.ndarray, w: np.ndarray):
        """For pairs of ids (v known or start, w known or -1): shard, local node or -1, relative name, discounted p, b(v).

        Each pair is looked up once, in order, so that neighbours in the files are read together.
        """
        key, back = np.unique((v.astype(np.uint64) << np.uint64(32)) | (w + 1).astype(np.uint64), return_inverse=True)
        v, w = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64) - 1
        n = len(v)
        node, rel = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        prob, bow = np.zeros(n), np.ones(n)
        key = (v.astype(np.uint64) << np.uint64(32)) | np.maximum(w, 0).astype(np.uint64)
        shard = (np.searchsorted(self.trie.bounds, key, "right") - 1).astype(np.uint32)
        edge = np.flatnonzero(np.diff(shard)) + 1
        for at in np.split(np.arange(n), edge) if n else ():
            opened = self._open(2, int(shard[at[0]]))
            if opened is None:
                continue
            parts = opened[0]
            parent = v[at] - int(parts["first"][0])
            bow[at] = VALUE[parts["bow"][parent]]
            ok = np.flatnonzero(w[at] >= 0)
            at, parent = at[ok], parent[ok]
            found, first = self._children(opened, parent, w[at])
            node[at] = found
            rel[at] = found - first
            hit = found >= 0
            prob[at[hit]] = VALUE[parts["prob"][found[hit]]]
        if len(self.split_word):
            k = np.minimum(np.searchsorted(self.split_word, v), len(self.split_word) - 1)
            at = np.flatnonzero(self.split_word[k] == v)
            bow[at] = self.split_bow[k[at]]
            rel[at] = self.trie.nodes[shard[at]] + node[at] - self.split_node[k[at]]
        return shard[back], node[back], rel[back], prob[back], bow[back]

    def trigrams(self, shard: np.ndarray, node: np.ndarray, rel: np.ndarray):
        """For level-2 nodes and relative names (or -1): discounted p and b(uv)."""
        prob, bow = np.zeros(len(node)), np.ones(len(node))
        for s, at in _by(shard):
            opened = self._open(3, s)
            if opened is None:
                continue
            parts = opened[0]
            bow[at] = VALUE[parts["bow"][node[at]]]
            at = at[rel[at] >= 0]
            key, back = np.unique((node[at].astype(np.uint64) << np.uint64(32)) | rel[at].astype(np.uint64), return_inverse=True)
            found, _ = self._children(opened, (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64))
            hit = found >= 0
            value = np.zeros(len(key))
            value[hit] = VALUE[parts["prob"][found[hit]]]
            prob[at] = value[back]
        return prob, bow


def _by(shard: np.ndarray):
    """(shard, places) of each shard present."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 65536 else shard, kind="stable")
    if not len(order):
        return
    edge = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, edge):
        yield int(shard[part[0]]), part


def _sequences(texts: list, reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' words on end, each text behind a start mark; and the marks' places."""
    h, _, begin = word_hashes([t or "" for t in texts])
    words, at = np.unique(h, return_inverse=True)
    marks = begin[:-1] + np.arange(len(texts))
    return np.insert(reader.word_ids(words.view(np.int64))[at], begin[:-1], reader.trie.start), marks


def _emit(buffer: list, n: int):
    """Sorted unique keys of a buffer of (shard, key) arrays, as (shard, blob) rows."""
    shard = np.concatenate([s for s, _ in buffer])
    key = np.concatenate([k for _, k in buffer])
    rows = []
    for s, at in _by(shard):
        k, c = np.unique(key[at], return_counts=True)
        rows.append((s, _squeeze(k, c)))
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])


def _merged(blobs) -> tuple[np.ndarray, np.ndarray]:
    found = [_unsqueeze(b) for b in blobs]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
    return keys, counts


def _level(parent: np.ndarray, name: np.ndarray, parents: int) -> dict[str, np.ndarray]:
    """Pointer and name sequences of children sorted by (parent, name)."""
    ptr = np.searchsorted(parent, np.arange(parents + 1))
    size = np.diff(ptr)
    full = np.flatnonzero(size)
    last = name[ptr[full + 1] - 1]
    base = np.zeros(parents, np.int64)
    base[full] = np.concatenate([[0], np.cumsum(last)[:-1]])
    return EliasFano.build(ptr, "ptr") | EliasFano.build(name + base[parent], "val")


def _vocabulary(docs: DataFrame, trie: Trie) -> None:
    def count(batches):
        held, n = [], 0

        def out():
            h = np.concatenate([x for x, _ in held])
            words, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for a, b in slices(texts):
                held.append(np.unique(word_hashes(texts[a:b])[0], return_counts=True))
                n += len(held[-1][0])
                if n > BUFFER:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    folder, mass = trie.folder, SHARD_TOKENS

    def write(batches):
        from pyspark import TaskContext

        name = f"vocab/{TaskContext.get().partitionId():07d}"
        h, n, total = [], [], 0
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            total += int(b.sum())
            h.append(a[b >= MIN_COUNT])
            n.append(b[b >= MIN_COUNT])
        h = np.concatenate(h) if h else np.empty(0, np.int64)
        n = np.concatenate(n) if n else np.empty(0, np.int64)
        cuts = []
        if len(h):
            put_blob(f"{folder}/{name}", pack({"hash": h, "count": n}))
            held = 0
            for i in np.flatnonzero((np.cumsum(n) // mass) != (np.cumsum(n) - n) // mass).tolist():
                pieces = int(n[i] // mass)
                cuts += [(i, k / max(1, pieces)) for k in range(max(1, pieces))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(h[0]) if len(h) else 0]), pa.array([len(h)], pa.int64()), pa.array([total], pa.int64()), pa.array([name]), pa.array([[float(i) for i, _ in cuts]], pa.list_(pa.float64())), pa.array([[x for _, x in cuts]], pa.list_(pa.float64()))],
            names=["h", "n", "total", "name", "at", "share"],
        )

    rows = counted.orderBy("h").mapInArrow(write, "h long, n long, total long, name string, at array<double>, share array<double>").collect()
    bounds = [0]
    for r in sorted((r for r in rows if r["n"]), key=lambda r: r["h"]):
        trie.parts.append((r["h"], trie.words, r["name"]))
        bounds += [(trie.words + int(i), x) for i, x in zip(r["at"], r["share"])]
        trie.words += r["n"]
    trie.tokens = sum(r["total"] for r in rows)
    if trie.words + 2 >= 1 << 32:
        raise ValueError("more than 2**32 words")
    keys = {0} | {(i << 32) | int(x * trie.words) for i, x in bounds[1:]}
    trie.bounds = np.array(sorted(keys), np.uint64)


def _level2(docs: DataFrame, trie: Trie) -> None:
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def send(batches):
        t = shared.value
        reader = Reader(t)
        buffer, held = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                seq, _ = _sequences(texts[a:b], reader)
                v, w = seq[:-1], seq[1:]
                ok = (v >= 0) & (w >= 0) & (w != t.start)
                key = (v[ok].astype(np.uint64) << np.uint64(32)) | w[ok].astype(np.uint64)
                buffer.append(((np.searchsorted(t.bounds, key, "right") - 1).astype(np.uint32), key))
                held += len(key)
                if held >= BUFFER:
                    yield _emit(buffer, held)
                    buffer, held = [], 0
        if held:
            yield _emit(buffer, held)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = shared.value
        reader, s = Reader(t), int(pdf["shard"].iloc[0])
        key, count = _merged(pdf["blob"])
        key, count = key[count >= MIN_COUNT], count[count >= MIN_COUNT]
        first = int(t.bounds[s] >> np.uint64(32))
        last = int((t.bounds[s + 1] - np.uint64(1)) >> np.uint64(32)) if s + 1 < len(t.bounds) else t.start
        v, w = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
        total = reader.word_counts(np.arange(first, last + 1))
        held = np.bincount(v - first, count - DISCOUNT, last - first + 1)
        parts = _level(v - first, w, last - first + 1)
        parts |= {"first": np.array([first]), "prob": quantise((count - DISCOUNT) / total[v - first]), "bow": quantise(1 - held / total)}
        put_blob(f"{t.folder}/level2/{s}", pack(parts))
        put_blob(f"{t.folder}/counts2/{s}", count.tobytes())
        return pd.DataFrame({"shard": [s], "n": [len(key)], "first": [first], "last": [last], "held_first": [held[0]], "held_last": [held[-1]], "c_first": [int(total[0])], "c_last": [int(total[-1])], "at_last": [int(np.searchsorted(v, last))]})

    schema = "shard long, n long, first long, last long, held_first double, held_last double, c_first long, c_last long, at_last long"
    rows = docs.select("text").mapInArrow(send, "shard long, blob binary").groupBy("shard").applyInPandas(build, schema).collect()
    by = {r["shard"]: r for r in rows}
    trie.shards2 = frozenset(by)
    size = np.array([by[s]["n"] if s in by else 0 for s in range(len(trie.bounds))], np.int64)
    trie.nodes = np.concatenate([[0], np.cumsum(size)[:-1]])
    held: dict[int, list] = {}
    for s in sorted(by):
        r = by[s]
        for v, sum_, c, at in {(r["first"], r["held_first"], r["c_first"], 0), (r["last"], r["held_last"], r["c_last"], r["at_last"])}:
            if v == r["first"] == r["last"] and at:
                continue
            held.setdefault(v, []).append((s, sum_, c, int(trie.nodes[s]) + at))
    for v, found in held.items():
        if len(found) > 1:
            bow = 1 - sum(x[1] for x in found) / found[0][2]
            trie.split[v] = (float(VALUE[quantise(np.array([bow]))[0]]), min(x[3] for x in found))


def _level3(docs: DataFrame, trie: Trie) -> None:
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def send(batches):
        t = shared.value
        reader = Reader(t)
        buffer, held = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                seq, _ = _sequences(texts[a:b], reader)
                v, w = seq[:-1], np.where(seq[1:] == t.start, -1, seq[1:])
                at = np.flatnonzero((v >= 0) & (w >= 0))
                shard, node, rel = np.zeros(len(v), np.uint32), np.full(len(v), -1, np.int64), np.zeros(len(v), np.int64)
                shard[at], node[at], rel[at], _, _ = reader.bigrams(v[at], w[at])
                ok = np.flatnonzero((node[:-1] >= 0) & (node[1:] >= 0))
                key = (node[ok].astype(np.uint64) << np.uint64(32)) | rel[ok + 1].astype(np.uint64)
                buffer.append((shard[ok], key))
                held += len(key)
                if held >= BUFFER:
                    yield _emit(buffer, held)
                    buffer, held = [], 0
        if held:
            yield _emit(buffer, held)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t, s = shared.value, int(pdf["shard"].iloc[0])
        key, count = _merged(pdf["blob"])
        key, count = key[count >= MIN_COUNT], count[count >= MIN_COUNT]
        total = get_blob(f"{t.folder}/counts2/{s}").view(np.int64)
        parent, name = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
        parts = _level(parent, name, len(total))
        parts |= {"prob": quantise((count - DISCOUNT) / total[parent]), "bow": quantise(1 - np.bincount(parent, count - DISCOUNT, len(total)) / total)}
        put_blob(f"{t.folder}/level3/{s}", pack(parts))
        return pd.DataFrame({"shard": [s]})

    rows = docs.select("text").mapInArrow(send, "shard long, blob binary").groupBy("shard").applyInPandas(build, "shard long").collect()
    trie.shards3 = frozenset(r["shard"] for r in rows)


def train(docs: DataFrame) -> Trie:
    """Count all of ``docs``' texts and build the trie in the shared folder."""
    texts = docs.where("text is not null")
    trie = Trie(shared_dir(docs.sparkSession))
    _vocabulary(texts, trie)
    # texts with words, for the start mark's count
    trie.documents = max(1, texts.where(F.col("text").rlike(r"[\p{L}\p{N}]")).count())
    # the start mark's followers are cut like those of a frequent word
    pieces = int(trie.documents // SHARD_TOKENS)
    cuts = {(trie.start << 32) | (k * trie.words // pieces) for k in range(pieces)} if pieces > 1 else set()
    trie.bounds = np.array(sorted(set(trie.bounds.tolist()) | cuts), np.uint64)
    _level2(texts, trie)
    _level3(texts, trie)
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """``doc_id, n_words, n_unknown, log_prob, perplexity`` for each row of ``docs``.

    ``log_prob`` is the natural logarithm over the whole text (4 decimals), ``perplexity``
    that of a word (2 decimals). A null text gives null in all but ``doc_id``; a text
    without words 0 words, log_prob 0 and a null perplexity. Null ids, repeated rows and
    other columns are left as they are; an empty table gives an empty result. One narrow
    pass over memory-mapped files, no shuffle. More than 2**32 - 2 different words are an error.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def work(batches):
        t = shared.value
        reader = Reader(t)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                part = texts[a:b]
                n, unknown, total = score_texts(part, reader)
                null = np.array([x is None for x in part])
                with np.errstate(over="ignore"):
                    ppl = np.round(np.exp(-total / np.maximum(n, 1)), 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n, pa.int64(), mask=null), pa.array(unknown, pa.int64(), mask=null), pa.array(np.round(total, 4) + 0.0, mask=null), pa.array(ppl, mask=null | (n == 0))],
                    names=["doc_id", "n_words", "n_unknown", "log_prob", "perplexity"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_words long, n_unknown long, log_prob double, perplexity double")


def score_texts(texts: list, reader: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, unknown words and log probability of each text."""
    t = reader.trie
    seq, marks = _sequences(texts, reader)
    mark = np.zeros(len(seq), bool)
    mark[marks] = True
    w = seq[1:]
    one = np.full(len(w), 1.0 / max(1, t.tokens))
    known = np.flatnonzero((w >= 0) & ~mark[1:])
    one[known] = reader.word_counts(w[known]) / max(1, t.tokens)
    v = seq[:-1]
    shard, node, rel = np.zeros(len(v), np.uint32), np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
    prob = one.copy()
    at = np.flatnonzero((v >= 0) & ~mark[1:])
    shard[at], node[at], r, d, bow = reader.bigrams(v[at], w[at])
    rel[at] = np.where(node[at] >= 0, r, -1)
    prob[at] = d + bow * one[at]
    at = np.flatnonzero(~mark[2:] & ~mark[1:-1] & (node[:-1] >= 0)) if len(v) > 1 else np.empty(0, np.int64)
    d, bow = reader.trigrams(shard[at], node[at], rel[at + 1])
    prob[at + 1] = d + bow * prob[at + 1]
    log = np.zeros(len(seq))
    log[1:] = np.where(mark[1:], 0.0, np.log(np.maximum(prob, 1e-300)))
    unknown = (seq < 0).astype(np.int64)
    size = np.diff(np.append(marks, len(seq))) - 1
    if not len(marks):
        return size, size, np.zeros(0)
    return size, np.add.reduceat(unknown, marks), np.add.reduceat(log, marks)


def lm_score(docs: DataFrame) -> DataFrame:
    """Score ``docs`` under a model of all their texts; see ``train`` and ``score``."""
    return score(docs, train(docs))
