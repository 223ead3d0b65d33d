"""Document fingerprints by consistent weighted sampling.

For a term with weight w and sample k, three draws that depend on (term, k) alone:
r, c ~ Gamma(2, 1) and b ~ U(0, 1); t = floor(ln w / r + b), ln a = ln c - r (t - b) - r.
The term with the least ln a is the sample (on a tie, the one with the least name), and (term, t) its name. Two documents agree
on a sample with probability sum min(w) / sum max(w), their generalised Jaccard similarity.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import HashCache, arrow_slices, give_back, mix, odd_constants, word_hashes

SAMPLES = 64
SEED = 17
#: Characters of text that a task works on at once; terms whose draws it holds, and makes at once.
SLICE, PART, STEP = 2 << 20, 250_000, 512
_MANY = np.uint64(0xD6E8FEB86659FD93)


def _uniform(h: np.ndarray, lane: int, samples: int) -> np.ndarray:
    """Draws in (0, 1] that depend on (term, lane, sample) alone: terms x samples."""
    bits = mix((h[:, None] ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * odd_constants(samples, SEED + lane)[None, :])
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def draws(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """ln a (float32) and sample names (int64), each terms x samples."""
    r = -np.log(_uniform(hashes, 1, samples) * _uniform(hashes, 2, samples))
    ln_c = np.log(-np.log(_uniform(hashes, 3, samples) * _uniform(hashes, 4, samples)))
    b = _uniform(hashes, 5, samples)
    t = np.floor(np.log(weights)[:, None] / r + b)
    ln_a = ln_c - r * (t - b) - r
    name = mix(hashes[:, None] + t.astype(np.int64).astype(np.uint64) * _MANY)
    return ln_a.astype(np.float32), name.view(np.int64)


class _Draws:
    """Text by text, from counts by word: what ``signatures`` is tested against."""

    def __init__(self, samples: int, limit: int = 60_000):
        self.samples, self.limit, self.row = samples, limit, {}
        self.ln_a = np.empty((limit, samples), np.float32)
        self.name = np.empty((limit, samples), np.int64)
        self.hash = HashCache(100_000)

    def signature(self, counts: Counter) -> np.ndarray:
        items = list(counts.items())
        best = name = None
        for i in range(0, len(items), self.limit):  # a text with more terms than the limit goes part by part
            a, n = self._part(items[i : i + self.limit])
            if best is not None:
                keep = (best < a) | ((best == a) & (name <= n))
                a, n = np.where(keep, best, a), np.where(keep, name, n)
            best, name = a, n
        return name

    def _part(self, items):
        new = [x for x in items if x not in self.row]
        if len(self.row) + len(new) > self.limit:
            self.row.clear()
            new = items
        if new:
            at = len(self.row)
            h = np.fromiter((self.hash[w] for w, _ in new), np.uint64, len(new))
            a, n = draws(h, np.fromiter((c for _, c in new), np.float64, len(new)), self.samples)
            self.ln_a[at : at + len(new)], self.name[at : at + len(new)] = a, n
            self.row.update(zip(new, range(at, at + len(new))))
        rows = np.fromiter(map(self.row.__getitem__, items), np.int64, len(items))
        a = self.ln_a[rows]
        k = a.argmin(0)
        lanes = np.arange(self.samples)
        best, name = a[k, lanes], self.name[rows[k], lanes]
        tie = a == best
        if np.count_nonzero(tie) > self.samples:  # of equal values the least name counts, in whatever order terms come
            for j in np.flatnonzero(tie.sum(0) > 1):
                name[j] = self.name[rows[tie[:, j]], j].min()
        return best, name


def _names(hashes: np.ndarray, weights: np.ndarray, lanes: np.ndarray, samples: int) -> np.ndarray:
    """The names that ``draws`` gives, of single (term, weight, sample): arrays of one length."""

    def uniform(lane: int) -> np.ndarray:
        bits = mix((hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * odd_constants(samples, SEED + lane)[lanes])
        return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53

    t = np.floor(np.log(weights) / -np.log(uniform(1) * uniform(2)) + uniform(5))
    return mix(hashes + t.astype(np.int64).astype(np.uint64) * _MANY).view(np.int64)


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words (see words_of) of all texts on end, their counts, and where each text's begin."""
    h, _, begin = word_hashes(texts)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[begin[:-1][begin[:-1] < len(h)]] = True
    at = np.flatnonzero(new)
    return h[at], np.diff(at, append=len(h)), np.searchsorted(at, begin)


def signatures(texts: list[str], samples: int = SAMPLES) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's signature (empty without words), and its number of terms. In a part, draws of equal (term, count) are made once."""
    h, n, begin = term_counts(texts)
    lanes, size = np.arange(samples), np.diff(begin)
    some = np.flatnonzero(size)
    start, stop = begin[some], begin[some + 1]
    best, term, tied = np.full((len(some), samples), np.inf, np.float32), np.zeros((len(some), samples), np.int64), []
    for lo in range(0, len(h), PART):
        hi = min(lo + PART, len(h))
        _, first, row = np.unique(mix(h[lo:hi] ^ mix(n[lo:hi].astype(np.uint64))), return_index=True, return_inverse=True)
        ln_a = np.empty((len(first), samples), np.float32)
        for i in range(0, len(first), STEP):
            at = lo + first[i : i + STEP]
            ln_a[i : i + STEP] = draws(h[at], n[at].astype(np.float64), samples)[0]
        for k in range(int(np.searchsorted(stop, lo, "right")), int(np.searchsorted(start, hi))):
            a, b = max(lo, int(start[k])), min(hi, int(stop[k]))
            own = ln_a[row[a - lo : b - lo]]
            least = own.argmin(0)
            value = own[least, lanes]
            tie, again = own == value, value == best[k]
            if np.count_nonzero(tie) > samples or again.any():
                tied += [(k, j, a + np.flatnonzero(tie[:, j]), value[j]) for j in np.flatnonzero((tie.sum(0) > 1) | again)]
            less = value < best[k]
            best[k, less], term[k, less] = value[less], a + least[less]
    name = _names(h[term.ravel()], n[term.ravel()].astype(np.float64), np.tile(lanes, len(some)), samples).reshape(-1, samples)
    for k, j, at, value in tied:  # of equal values the least name counts, in whatever order terms come
        if value == best[k, j]:
            name[k, j] = min(name[k, j], _names(h[at], n[at].astype(np.float64), np.full(len(at), j), samples).min())
    out: list = [np.empty(0, np.int64)] * len(texts)
    for k, i in enumerate(some.tolist()):
        out[i] = name[k]
    return out, size


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_terms, signature`` (array of ``samples`` longs) for each row of ``docs``.

    Terms are words, weights their counts in the whole text. A null text gives a null
    signature and count, a text without words an empty signature and 0. Equal texts have
    equal signatures. Null ids, repeated rows and other columns are left as they are; an
    empty table gives an empty result. One narrow pass, no shuffle.
    """

    def work(batches):
        for batch in batches:
            for a, b in arrow_slices(batch.column(1), SLICE):
                texts = batch.column(1)[a:b].to_pylist()
                sigs, n = signatures([t or "" for t in texts], samples)
                null = np.array([t is None for t in texts])
                sigs = [None if gone else s for s, gone in zip(sigs, null)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n.astype(np.int32), mask=null), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_terms", "signature"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_terms int, signature array<long>")
