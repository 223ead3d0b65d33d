"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel.

The kernel of two strings sums, over all subsequences of ORDER characters that both
hold, DECAY to the length each spans, and is normalised. Strings are the units of a
sentence: its tokens, and runs of one-character tokens read as one ("i d i o t").
A sentence is as toxic as its worst unit, a document as its worst sentence.

Training (bounded sample, on the driver) is multiple-instance: the sentences of documents
labelled toxic hold at least one bad unit, unknown which. Witness units are those that
occur in toxic texts with many different neighbours and hardly in clean ones, by
themselves or with the other forms of their stem; the machine is fitted on Nystrom features over landmarks, then clean units that it takes for
toxic join the negatives, and it is fitted again. In the kernel's own feature space the
decision function is one weight for each subsequence, which scoring uses: that equals
the sum over landmarks and costs as much as one of them.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Characters of a subsequence, decay for each character that it spans.
ORDER, DECAY = 3, 0.6
#: Labelled documents of each class that the machine is fitted on, by the least md5 of their id.
TRAIN_ROWS = 1000
#: Clean units that join the negatives in a round, and are landmarks besides the witnesses; negatives to begin with.
MINED, MOST_UNITS = 300, 3000
#: A witness is in so many toxic texts, and has this share of its different left neighbours in toxic ones;
#: the units that continue its stem have the latter share, without the witness.
MIN_TEXTS, MIN_SHARE, STEM_SHARE = 3, 0.9, 0.75
#: Units that may become witnesses by chance alone, in expectation.
CHANCE = 5
#: Longer tokens are scored in overlapping pieces of this length.
PIECE = 24
#: Weight of all witnesses against all negatives; what the bias is lowered by.
POSITIVE, MARGIN = 0.15, 0.6
_START, _END = "\x02", "\x03"
_SYMBOLS = 34
_CODES = _SYMBOLS**ORDER
_FOLD: dict[str, int] = {_START: 32, _END: 33}


def _code(ch: str) -> int:
    """a-z as 1-26 without accents, digits that stand for letters as those, other letters as 27-31, marks as 0."""
    got = _FOLD.get(ch)
    if got is None:
        base = unicodedata.normalize("NFD", ch)[0]
        base = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.get(base, base)
        got = ord(base) - 96 if "a" <= base <= "z" else 27 + ord(base) % 5 if base.isalpha() else 0
        if len(_FOLD) < 65536:
            _FOLD[ch] = got
    return got


def unit(token: str) -> str:
    """A token in lower case without marks at its ends."""
    token = token.lower()
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _TRIPLES:
        at = np.array(list(itertools.combinations(range(n), ORDER)), dtype=np.int64)
        _TRIPLES[n] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)
    return _TRIPLES[n]


def _subsequences(units: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For units of n characters: codes (sorted) and summed weights, zero where a code goes on."""
    chars = np.array([[_code(c) for c in u] for u in units], dtype=np.int64)
    at, weight = _triples(n)
    code, marked = chars[:, at[:, 0]], chars[:, at[:, 0]] == 0
    for k in range(1, ORDER):
        code = code * _SYMBOLS + chars[:, at[:, k]]
        marked |= chars[:, at[:, k]] == 0
    code[marked] = 0  # marks only widen a span: subsequences are of letters
    order = np.argsort(code, axis=1, kind="stable")
    code = np.take_along_axis(code, order, 1)
    total = np.cumsum(np.where(code == 0, 0, weight[order].astype(np.float64)), axis=1)
    end = np.ones(code.shape, dtype=bool)
    end[:, :-1] = code[:, 1:] != code[:, :-1]
    # the sum of a run is the running total at its end less that at the end before
    held = np.maximum.accumulate(np.where(end, total, 0), axis=1)
    before = np.concatenate([np.zeros((len(units), 1)), held[:, :-1]], 1)
    return code, np.where(end, total - before, 0)


def _pieces(u: str) -> list[str]:
    if len(u) <= PIECE:
        return [u]
    return [u[i : i + PIECE] for i in range(0, len(u) - PIECE // 2, PIECE // 2)]


def dense(units: list[str]) -> np.ndarray:
    """Normalised kernel features of short units, units x codes."""
    out = np.zeros((len(units), _CODES), np.float32)
    for i, u in enumerate(units):
        if len(u) >= ORDER:
            code, w = _subsequences([u], len(u))
            out[i, code[0][w[0] > 0]] = w[0][w[0] > 0]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out, dtype=np.float64))[:, None]
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


def _framed(u: str) -> str:
    """With marks of its start and end, so that a stem at the start isn't one inside."""
    return f"{_START}{u}{_END}"


def _feature(u: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a short unit in its frame, and their normalised kernel features."""
    u = _framed(u)
    code, w = _subsequences([u], len(u))
    held = w[0] > 0
    return code[0][held], (w[0][held] / max(math.sqrt((w[0] ** 2).sum()), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    """Decision function: weights . features + bias, toxic from 0 on."""

    weights: np.ndarray
    bias: float
    clean: frozenset = frozenset()

    def score(self, units: list[str]) -> np.ndarray:
        """Decision values; a longer unit has its worst piece's.

        A unit of ``clean`` (clean training texts hold it time and again) has the bias, and so has a
        piece with fewer than ORDER characters that can be read as letters.
        """
        out = np.full(len(units), self.bias)
        by_length = defaultdict(list)
        for i, u in enumerate(units):
            for piece in () if u in self.clean else _pieces(u):
                if sum(_code(c) > 0 for c in piece) >= ORDER:
                    piece = _START * (u.startswith(piece)) + piece + _END * (u.endswith(piece))
                    by_length[len(piece)].append((i, piece))
        for n, found in by_length.items():
            step = max(16, 200_000 // len(_triples(n)[0]))
            for s in range(0, len(found), step):
                part = found[s : s + step]
                code, w = _subsequences([u for _, u in part], n)
                value = (self.weights[code] * w).sum(1) / np.maximum(np.sqrt((w * w).sum(1)), 1e-12) + self.bias
                np.maximum.at(out, [i for i, _ in part], value)
        return out


def sentences(text: str) -> list[str]:
    """Pieces of a text between line ends and full stops."""
    return [s for line in text.splitlines() for s in line.replace("! ", ". ").replace("? ", ". ").split(". ") if s.strip()]


def variants(u: str) -> list[str]:
    """The unit with one character put in, at each inner place; with a gap at all of them."""
    return [u[:i] + mark + u[i:] for i in range(1, len(u)) for mark in ("*", u[i - 1])] + ["*".join(u)]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-1, rounds: int = 60) -> np.ndarray:
    """L2-regularised squared-hinge machine by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], reg)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = ridge * w - (x[on] * (weight * y * gap)[on, None]).sum(0)
        hess = (x[on] * weight[on, None]).T @ x[on] + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _seen(texts: list[str]) -> tuple[Counter, Counter]:
    """unit -> different left neighbours; texts that show it with one that no text before had.

    Near copies bring no new neighbours, so they don't count again.
    """
    known: set[tuple[str, str]] = set()
    around, held = Counter(), Counter()
    for text in texts:
        fresh = []
        for s in sentences(text):
            before = ""
            for token in s.split():
                u = unit(token)
                if ORDER <= len(u) <= PIECE and (u, before) not in known:
                    known.add((u, before))
                    fresh.append(u)
                before = u
        around.update(fresh)
        held.update(set(fresh))
    return around, held


def _unlikely(p: int, n: int, share: float, tests: int) -> bool:
    """Whether p of p + n would be toxic in fewer than CHANCE of ``tests`` by chance (Chernoff's bound)."""
    x = p / max(1, p + n)
    if x <= share:
        return False
    gap = x * math.log(x / share) + ((1 - x) * math.log((1 - x) / (1 - share)) if n else 0)
    return (p + n) * gap >= math.log(max(1, tests) / CHANCE)


def witnesses(toxic: list[str], clean: list[str]) -> tuple[list[str], dict[str, int]]:
    """Units that tell toxic texts, and common units of clean ones; those in doubt are neither.

    A witness is nearly always in toxic texts, and stands out there by itself, or does so
    together with the other units that continue its stem (a rare language has too few texts for
    each form of a word).
    """
    (bad, held), (good, _) = _seen(toxic), _seen(clean)
    units = bad.keys() | good.keys()
    share = min(max(bad.total() / max(1, bad.total() + good.total()), 1e-9), 0.99)
    family: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for u in units:
        for i in range(ORDER, len(u)):
            total = family[u[:i]]
            total[0] += bad[u]
            total[1] += good[u]

    def by_stem(u: str) -> bool:
        for i in range(ORDER, len(u)):
            p, n = family[u[:i]][0] - bad[u], family[u[:i]][1] - good[u]  # without its own say
            if p >= STEM_SHARE * (p + n) and _unlikely(p, n, share, len(family)):
                return True
        return False

    likely = {u for u in units if held[u] >= MIN_TEXTS and bad[u] >= MIN_SHARE * (bad[u] + good[u])}
    witness = sorted((u for u in likely if _unlikely(bad[u], good[u], share, len(units)) or by_stem(u)), key=lambda u: (-bad[u], u))
    doubt = {u for u in units if held[u] >= MIN_TEXTS and bad[u] > good[u] and (u in likely or by_stem(u))}
    common = {u: good[u] for u in sorted((u for u in good if u not in doubt), key=lambda u: (-good[u], u))}
    return witness, common


def fit_sentences(toxic: list[str], clean: list[str], rounds: int = 16) -> Machine:
    """Fit on labelled texts; without witnesses nothing is toxic."""
    witness, common = witnesses(toxic, clean)
    if not witness or not common:
        return Machine(np.zeros(_CODES, np.float32), -1.0)
    names = list(common)
    step = max(1, len(names) // (MOST_UNITS // 2))
    negative = list(dict.fromkeys(names[: MOST_UNITS // 2] + names[::step]))[:MOST_UNITS]
    positive = witness + [v for u in witness for v in variants(u)]
    features = {u: _feature(u) for u in dict.fromkeys(positive + negative)}
    known = frozenset(u for u in names if common[u] >= MIN_TEXTS)
    for _ in range(rounds):
        marks = list(dict.fromkeys(witness + negative[-MINED:]))
        columns = np.ascontiguousarray(dense([_framed(u) for u in marks]).T)
        gram, kernel = (np.array([features[u][1] @ columns[features[u][0]] for u in part], np.float64) for part in (marks, positive + negative))
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weight = np.array([0.0] * len(positive) + [math.sqrt(common[u]) for u in negative])
        weight[: len(positive)] = POSITIVE * weight.sum() / len(positive)
        w = _svm(kernel @ root, y, weight)
        machine = Machine((columns @ (root @ w[:-1]).astype(np.float32)).astype(np.float32), float(w[-1]))
        score, taken = machine.score(names), set(negative)
        worst = [i for i in np.argsort(-score, kind="stable")[: len(taken) + MINED] if score[i] > -0.5]
        fresh = [names[i] for i in worst if names[i] not in taken][:MINED]
        if not fresh:
            break
        features.update((u, _feature(u)) for u in fresh)
        negative += fresh
    return Machine(machine.weights, machine.bias - MARGIN, known)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on the sentences of at most ``train_rows`` labelled documents of each class.

    Labels that are null, or whose document is missing or null, teach nothing.
    """
    parts = []
    for side in (1, 0):
        rows = labels.where(F.col("toxic") == side).select("doc_id").distinct()
        parts.append(rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(train_rows).withColumn("side", F.lit(side)))
    chosen = parts[0].unionByName(parts[1])
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "side").toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    groups: dict[int, list[str]] = {1: [], 0: []}
    for row in found:
        groups[row["side"]].append(row["text"])
    return fit_sentences(groups[1], groups[0])


class _Units:
    """Token -> row of its decision value and of whether it is one character; bounded."""

    def __init__(self, machine: Machine, limit: int = 250_000):
        self.machine, self.limit, self.row = machine, limit, {}
        self.value, self.single = np.empty(limit), np.empty(limit, dtype=bool)

    def rows(self, tokens: list[str]) -> np.ndarray:
        new = [t for t in dict.fromkeys(tokens) if t not in self.row]
        if len(self.row) + len(new) > self.limit:
            self.row.clear()
            new = list(dict.fromkeys(tokens))
            if len(new) > self.limit:
                self.__init__(self.machine, 2 * len(new))
        if new:
            at, units = len(self.row), [unit(t) for t in new]
            self.value[at : at + len(new)] = self.machine.score(units)
            self.single[at : at + len(new)] = [len(u) == 1 for u in units]
            self.row.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))


def _spelled(tokens: list[str], single: np.ndarray) -> list[tuple[int, str]]:
    """(place, unit) of runs of ORDER or more one-character tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    return [(int(a), "".join(unit(t) for t in tokens[a:b])) for a, b in zip(edge[::2], edge[1::2]) if b - a >= ORDER]


SCHEMA = "score double, toxic boolean, worst string, n_toxic int"


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score, toxic, worst, n_toxic`` for each row of ``docs``.

    ``score`` is the decision value of the worst unit, rounded to 4 decimals, ``worst`` that
    unit (the first on a tie), ``n_toxic`` how many tokens are toxic, spelled-out runs
    counted as one. A null text gives null in all but ``doc_id``; a text without tokens has
    a null score and unit and isn't toxic. Texts are read whole. Null ids, repeated rows
    and other columns are left as they are; an empty table gives an empty result. One
    narrow pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches):
        units = _Units(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 20):
                tokens, size = [], []
                for t in texts[a:b]:
                    parts = t.split() if t else []
                    tokens += parts
                    size.append(len(parts))
                rows = units.rows(tokens)
                value, single = units.value[rows].copy(), units.single[rows]
                start = np.concatenate([[0], np.cumsum(size)])
                out = [[], [], [], []]
                for i, t in enumerate(texts[a:b]):
                    s, e = start[i], start[i + 1]
                    if t is None or s == e:
                        for x, none in zip(out, (None, None if t is None else False, None, None if t is None else 0)):
                            x.append(none)
                        continue
                    v = value[s:e]
                    k = int(v.argmax())
                    best, worst, hits = float(v[k]), unit(tokens[s + k]), int((v >= 0).sum())
                    if single[s:e].any():
                        run = _spelled(tokens[s:e], single[s:e])
                        if run:
                            found = units.machine.score([u for _, u in run])
                            hits += int((found >= 0).sum())
                            j = int(found.argmax())
                            if found[j] > best:
                                best, worst = float(found[j]), run[j][1]
                    for x, got in zip(out, (round(best, 4), best >= 0, worst, hits)):
                        x.append(got)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(out[0], pa.float64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32())],
                    names=["doc_id", "score", "toxic", "worst", "n_toxic"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {SCHEMA}")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents, score all; see ``fit`` and ``score_documents``."""
    return score_documents(docs, fit(docs, labels))
