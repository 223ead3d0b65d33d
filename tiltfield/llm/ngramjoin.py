"""N-gram Jaccard join over count vectors in R-trees, without a lost pair.

A document is the set of hashes of its word n-grams. Documents with equal sets form a
class, of which one stands for all. A set's n-grams fall into GROUPS groups by hash; their
counts are a point, and two sets share at most the sum of their coordinates' minima.

A single tree over the corpus can't be spread over executors, since in so many dimensions
its boxes overlap. So sets fall into blocks, one for each n-gram of a rarest-first prefix:
in any one order of all n-grams, two sets of p and q that share at least
a = T / (1 + T) (p + q) of them must both have the first shared one among their first p - a + 1 and
q - a + 1. A pair is looked at in the block of its first shared n-gram only (blocks in which
two rows have one of their last LAST prefix n-grams in common are known not to be that one),
where its places in both sets bound the overlap too. The order goes by document frequency:
a first pass counts n-grams into a table of the shared folder. Any table would do, rare
n-grams first just keep blocks small; n-grams of a single document need no block. A second
pass sends only places and sizes and finds the blocks in which some pair's places allow
the threshold; just their rows, with the points, are sent by the third.

Each block's points are bulk-loaded into an R-tree, which is joined with itself: two
nodes, then two points, go on only while the bounds allow the threshold. A block of more
than HOT sets is cut into chunks that meet pairwise in blocks of their own, so that no task
holds an unbounded one. Surviving pairs are gathered by the least class that the lesser one
of a pair is paired with, so that what is known of a set travels about once to all that is
like it; such gatherings are cut like blocks. In a gathering first sketches meet (a bit for
each hash of an n-gram, a few bits an n-gram, which bound the overlap too), then, of the
pairs that are left, the texts, and pairs are verified on the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, arrow_slices, get_blob, give_back, materialize, mix, put_blob, row_keys, shared_dir, slices, word_hashes
from .urlfilter import bloom

#: Words of an n-gram, least Jaccard similarity of a pair.
NGRAM, THRESHOLD = 2, 0.5
#: Coordinates of a point; points of a leaf, children of a node; n-grams before its own that a row of a block names.
GROUPS, LEAF, FANOUT, LAST = 16, 64, 16, 2
#: Sets of a block (by the frequency table) from which it is cut; rows that a task of blocks aims at.
HOT, PART_ROWS = 8192, 200_000
#: Bits of an n-gram's name in the tables, which only order and leave out; those of one name share what is known.
NAME_BITS = 40
#: Steps to lesser neighbours that decide where a pair is verified.
STEPS = 3
#: N-grams that a task counts at once; characters of text whose n-grams one task merges; bits of a file of frequencies.
BUFFER, SHARD_CHARS, FILE_BITS = 2_000_000, 32 << 20, 24
#: Characters of text whose n-grams are found at once.
CACHE_CHARS = 1 << 17
_SEED = 41
_U = np.uint64


class _Grams:
    """Sorted distinct n-gram hashes of texts.

    A text of fewer words than an n-gram has is one short n-gram; one without words has none.
    """

    def __init__(self, n: int):
        self.n = n

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sets of texts laid end to end, and their sizes; few texts at once, whose arrays fit a processor's cache."""
        parts = [self._some(texts[a:b]) for a, b in slices(texts, CACHE_CHARS)] or [self._some(texts)]
        return np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h, _, start = word_hashes(texts)
        n, words = self.n, np.diff(start)
        text = np.repeat(np.arange(len(texts)), words)
        gram, last = h, np.arange(len(h))
        for i in range(1, n):
            on = np.minimum(last + i, len(h) - 1)
            # within its text a run grows; at the end of a text that is too short it stays as it is
            ok = (last + i < len(h)) & (text[on] == text) if len(h) else np.zeros(0, bool)
            gram = np.where(ok, mix(gram * _U(0x9E3779B97F4A7C15) + h[on]), gram)
        whole = np.arange(len(h)) + n <= start[1:][text] if len(h) else np.zeros(0, bool)
        whole |= (words < n)[text] & (np.arange(len(h)) == start[:-1][text])
        gram, text = mix(gram[whole]), text[whole]
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            gram[a:b].sort()
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
        return gram[fresh], np.bincount(text[fresh], minlength=len(texts))


class _Sets:
    """The sets of a slice of texts, their classes, and which classes this task meets for the first time."""

    def __init__(self, n: int):
        self.grams, self.seen = _Grams(n), set()

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """N-grams on end, sizes, class names (None without words), whether each is new."""
        g, size = self.grams.many([t or "" for t in texts])
        names: list = [None] * len(texts)
        new = np.zeros(len(texts), bool)
        some = np.flatnonzero(size)
        if len(some):
            start = (np.cumsum(size) - size)[some]
            one, two = np.add.reduceat(mix(g), start), np.add.reduceat(mix(g ^ _U(_SEED)), start)
            for i, x, y in zip(some.tolist(), one, two):
                names[i] = name = x.tobytes() + y.tobytes()
                if name not in self.seen:
                    self.seen.add(name)
                    new[i] = True
        return g, size, names, new


# --- tables of n-grams ---


class Table:
    """Bytes by the leading bits of an n-gram, in layers; files in the shared folder. 0 where nothing was put."""

    def __init__(self, folder: str, bits: int, layers: int):
        self.folder, self.bits, self.layers = folder, bits, layers
        self.open: dict = {}

    def _part(self, f: int) -> np.ndarray:
        if f not in self.open:
            self.open[f] = get_blob(f"{self.folder}/{f}").reshape(self.layers, -1)
        return self.open[f]

    def get(self, grams: np.ndarray) -> np.ndarray:
        """Layers x n-grams."""
        slot = (grams >> _U(64 - self.bits)).astype(np.int64)
        if self.bits <= FILE_BITS:
            return self._part(0)[:, slot]
        out, part = np.empty((self.layers, len(slot)), np.uint8), slot >> FILE_BITS
        for f in np.unique(part).tolist():
            at = np.flatnonzero(part == f)
            out[:, at] = self._part(f)[:, slot[at] & ((1 << FILE_BITS) - 1)]
        return out

    def again(self) -> Table:
        """The same table, to open in a task."""
        return Table(self.folder, self.bits, self.layers)


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed planes of bytes."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def _columns(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 0, []
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


class _Ranges:
    """How tables are built: tasks send sorted short names by range, a range is merged at once, files hold several.

    Slots grow with the text, up to 2**33; beyond it more n-grams share one.
    """

    def __init__(self, docs: DataFrame):
        chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        self.bits = min(33, max(10, int(chars // 16).bit_length()))
        # ranges are no coarser than files
        self.log = min(self.bits, max(int(chars // SHARD_CHARS).bit_length(), self.bits - FILE_BITS, 1))

    def emit(self, names: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        """``shard, blob`` of rows with sorted names."""
        shard = (names >> _U(NAME_BITS - self.log)).astype(np.int64)
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        cut = zip(*(np.split(c, at[1:]) for c in (names, *columns)))
        blobs = [_planes(np.diff(x, prepend=_U(0)), *c) for x, *c in cut] if len(at) else []
        return pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    def build(self, sent: DataFrame, merge, kinds: tuple, layers: int, folder: str) -> Table:
        """``merge(names, *columns)`` gives names and layers of bytes; of a slot's names the greatest bytes count."""
        bits, width, file_bits = self.bits, self.bits - self.log, min(self.bits, FILE_BITS)

        def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
            s = int(pdf["shard"].iloc[0])
            found = [_columns(b, "u8", *kinds) for b in pdf["blob"]]
            columns = [np.concatenate([np.cumsum(f[0], dtype=_U) for f in found]), *(np.concatenate([f[i] for f in found]) for i in range(1, 1 + len(kinds)))]
            names, values = merge(*columns)
            table, slot = np.zeros((layers, 1 << width), np.uint8), (names >> _U(NAME_BITS - bits)).astype(np.int64) - (s << width)
            for layer, value in zip(table, values):
                np.maximum.at(layer, slot, value)
            return pd.DataFrame({"file": [(s << width) >> file_bits], "at": [(s << width) & ((1 << file_bits) - 1)], "part": [table.tobytes()]})

        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            f = int(pdf["file"].iloc[0])
            table = np.zeros((layers, 1 << file_bits), np.uint8)
            for at, part in zip(pdf["at"], pdf["part"]):
                if part:
                    table[:, at : at + (1 << width)] = np.frombuffer(part, np.uint8).reshape(layers, -1)
            put_blob(f"{folder}/{f}", table.tobytes())
            return pd.DataFrame({"file": [f]})

        parts = sent.groupBy("shard").applyInPandas(reduce, "file long, at long, part binary")
        every = sent.sparkSession.range(1 << (bits - file_bits)).select(F.col("id").alias("file"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("part"))
        parts.unionByName(every).groupBy("file").applyInPandas(write, "file long").collect()
        return Table(folder, bits, layers)


def _counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names and how often each is there; empties the list."""
    names = np.concatenate(held)
    held.clear()
    names.sort()
    new = np.ones(len(names), bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return names[at], np.diff(at, append=len(names)).astype(np.uint32)


def frequencies(docs: DataFrame, ranges: _Ranges, n: int, folder: str) -> Table:
    """In how many sets each n-gram is, four codes to a doubling from 1 (two sets) on; a class counts once a task."""

    def count(batches):
        sets, held, size = _Sets(n), [], 0
        for batch in batches:
            for a, b in arrow_slices(batch.column(0), 1 << 20, SLICE_BYTES):
                g, sizes, _, new = sets(batch.column(0)[a:b].to_pylist())
                held.append(g[np.repeat(new, sizes)] >> _U(64 - NAME_BITS))
                size += len(held[-1])
                if size > BUFFER:
                    yield ranges.emit(*_counted(held))
                    size = 0
        if size:
            yield ranges.emit(*_counted(held))
        del sets
        give_back()

    def merge(names, counts):
        names, at = np.unique(names, return_inverse=True)
        k = np.bincount(at, counts, len(names))
        return names[k > 1], [np.minimum(255, 1 + np.floor(4 * np.log2(k[k > 1]))).astype(np.uint8)]

    return ranges.build(docs.select("text").mapInArrow(count, "shard long, blob binary"), merge, ("u4",), 1, folder)


def _size_code(size: np.ndarray) -> np.ndarray:
    """1-255, eight to a doubling."""
    return np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(size, 1)))).astype(np.int64)


def _fits(p, q, i, j, threshold: float) -> np.ndarray:
    """Whether sets of p and q may reach the threshold if the first n-gram they share is at places i and j."""
    need = threshold / (1 + threshold) * (p + q) - 1e-6
    return (np.minimum(p - i, q - j) >= need) & (np.minimum(p, q) >= threshold * np.maximum(p, q) - 1e-6)


def with_partners(docs: DataFrame, ranges: _Ranges, frequency: Table, n: int, threshold: float, folder: str) -> Table:
    """Sizes between which sets may have a partner in an n-gram's block: codes of the greatest, and 256 less that of the least.

    A few bytes a prefix n-gram travel (place and size); in a block of at most LEAF sets
    all pairs of places are tried, a larger one is taken as it is.
    """

    def send(batches):
        sets, table, held, size = _Sets(n), frequency.again(), [], 0

        def out():
            names, p, i = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(names, kind="stable")
            return ranges.emit(names[order], p[order], i[order])

        for batch in batches:
            for a, b in arrow_slices(batch.column(0), 1 << 20, SLICE_BYTES):
                g, sizes, _, new = sets(batch.column(0)[a:b].to_pylist())
                g, sizes = g[np.repeat(new, sizes)], np.where(new, sizes, 0)
                who, place, at = prefixes(g, table.get(g)[0], sizes, threshold)
                held.append((g[at] >> _U(64 - NAME_BITS), sizes[who].astype(np.uint32), place.astype(np.uint32)))
                size += len(at)
                if size > BUFFER:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def merge(names, p, i):
        order = np.argsort(names, kind="stable")
        names, p, i = names[order], p[order].astype(np.int64), i[order].astype(np.int64)
        start = np.flatnonzero(np.diff(names, prepend=names[:1] + _U(1)))
        rows = np.diff(np.append(start, len(names)))
        alive = np.repeat(rows > LEAF, rows)
        for m in np.unique(rows[(rows > 1) & (rows <= LEAF)]).tolist():
            first, (x, y) = start[rows == m], np.triu_indices(m, 1)
            step = max(1, (1 << 19) // len(x))
            for s in range(0, len(first), step):
                a, b = ((first[s : s + step, None] + k).ravel() for k in (x, y))
                fit = _fits(p[a], p[b], i[a], i[b], threshold)
                alive[a[fit]] = alive[b[fit]] = True
        code = _size_code(p[alive])
        return names[alive], [code.astype(np.uint8), (256 - code).astype(np.uint8)]

    return ranges.build(docs.select("text").mapInArrow(send, "shard long, blob binary"), merge, ("u4", "u4"), 2, folder)


# --- sets, their points and prefixes ---


def sketches(grams: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets laid end to end: a bit for each hash that an n-gram has, on end in bytes, and each sketch's length.

    A set of n has a power of two of bits, 2 n to 4 n, at least 64. Half of a sketch on
    the other half is the sketch with half the bits.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64)) * (size > 0)
    owner = np.repeat(np.arange(len(size)), size)
    flags = np.zeros(int(bits.sum()), bool)
    flags[(np.cumsum(bits) - bits)[owner] + (mix(grams ^ _U(_SEED + 1)) & (bits[owner] - 1).astype(_U)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little"), bits // 8


def _points(grams: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Counts of each set's n-grams by group: sets x GROUPS."""
    return np.bincount(owner * GROUPS + (mix(grams) % _U(GROUPS)).astype(np.int64), minlength=sets * GROUPS).reshape(sets, GROUPS).astype(np.uint32)


def prefixes(grams: np.ndarray, codes: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets laid end to end: set, place and index of the n-grams that get a block.

    Places are those in the order by (code, n-gram); those beyond the prefix, and n-grams
    of a single set, are left out.
    """
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(owner * 256 + codes, kind="stable")  # n-grams ascend already
    place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
    longest = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    keep = (place < longest[owner]) & (codes[order] > 0)
    return owner[keep], place[keep], order[keep]


def features(docs: DataFrame, frequency: Table, partners: Table, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``k1, k2, doc_id, cls, name, size, n_blocks, point, grams, places, sketch`` of every row; ``name`` is half of ``cls``.

    Only prefix n-grams in whose blocks the set may have a partner are there. A row without
    words has no class. Of a class that a task meets again, and without words, the last
    five are empty.
    """

    def work(batches):
        sets, table, alive = _Sets(n), frequency.again(), partners.again()
        for batch in batches:
            for a, b in arrow_slices(batch.column(3), 1 << 20, SLICE_BYTES):
                g, size, names, new = sets(batch.column(3)[a:b].to_pylist())
                owner = np.repeat(np.arange(b - a), size)
                on = new[owner]
                g, owner, held = g[on], owner[on], np.where(new, size, 0)
                who, place, at = prefixes(g, table.get(g)[0], held, threshold)
                code, (most, least) = _size_code(held[who]), alive.get(g[at])
                keep = (code <= most) & (256 - code <= least)
                who, place, at = who[keep], place[keep], at[keep]
                k = np.bincount(who, minlength=b - a)
                ends = np.cumsum(k).tolist()
                point = _points(g, owner, b - a)
                grams, places = g[at].tobytes(), place.astype(np.uint32).tobytes()
                cut = list(zip([0, *ends[:-1]], ends))
                some = k > 0
                bits, length = sketches(g[some[owner]], held * some)
                bits, upto = bits.tobytes(), np.cumsum(length).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i)[a:b] for i in range(3)), pa.array(names, pa.binary()), pa.array([x and int.from_bytes(x[:8], "little", signed=True) for x in names], pa.int64()), pa.array(size, pa.int32()), pa.array(k, pa.int32()),
                        pa.array([p.tobytes() if x else b"" for p, x in zip(point, k)], pa.binary()),
                        pa.array([grams[8 * x : 8 * y] for x, y in cut], pa.binary()), pa.array([places[4 * x : 4 * y] for x, y in cut], pa.binary()),
                        pa.array([bits[x:y] for x, y in zip([0, *upto[:-1]], upto)], pa.binary()),
                    ],
                    names=["k1", "k2", "doc_id", "cls", "name", "size", "n_blocks", "point", "grams", "places", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(work, f"k1 long, k2 long, doc_id {kind}, cls binary, name long, size int, n_blocks int, point binary, grams binary, places binary, sketch binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*row_keys("doc_id", "text"), "doc_id", "text")


# --- blocks ---


class RTree:
    """R-tree over count vectors, bulk-loaded; only upper corners matter to the bound.

    ``tag`` names the n-gram before a row's own, 0 if there is none: rows of one tag have met before.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, tag: np.ndarray | None = None, leaf: int = LEAF, fanout: int = FANOUT):
        tag = np.zeros(len(points), _U) if tag is None else tag
        self.order = self._tile(points, sizes, tag, leaf)
        self.leaf, self.fanout = leaf, fanout
        self.levels = []  # from the leaves up: upper corners, least and greatest sizes and tags
        top, lo, hi, t0, t1 = points[self.order], sizes[self.order], sizes[self.order], tag[self.order], tag[self.order]
        while len(self.levels) == 0 or len(top) > 1:
            at = np.arange(0, len(top), fanout if self.levels else leaf)
            top, lo, hi, t0, t1 = np.maximum.reduceat(top, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(t0, at), np.maximum.reduceat(t1, at)
            self.levels.append((top, lo, hi, t0, t1))

    @staticmethod
    def _tile(points, sizes, tag, leaf):
        order = np.lexsort((sizes, tag))
        parts = np.split(order, np.flatnonzero(tag[order[1:]] != tag[order[:-1]]) + 1)
        large, small = [p for p in parts if len(p) > leaf], [p for p in parts if len(p) <= leaf]
        todo, out = large[::-1], []
        if small:
            out.append(np.concatenate(small))
        while todo:
            part = todo.pop()
            if len(part) <= leaf:
                out.append(part)
                continue
            spread = points[part].var(0)
            part = part[np.argsort(points[part, int(spread.argmax())], kind="stable")]
            half = max(leaf, (len(part) // 2 + leaf - 1) // leaf * leaf)
            todo += [part[half:], part[:half]]
        return np.concatenate(out)

    def join(self, threshold: float):
        """Index pairs (into the points as given) of leaves' points that the nodes' bounds can't rule out, in parts."""
        share = threshold / (1 + threshold)
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                a, b = self._children(a, b, self.fanout, len(self.levels[level][0]))
            keep = np.concatenate([self._may(self.levels[level], a[i : i + 65536], b[i : i + 65536], share, threshold) for i in range(0, len(a), 65536)] or [np.empty(0, bool)])
            a, b = a[keep], b[keep]
        step = max(1, (1 << 20) // self.leaf**2)
        for i in range(0, len(a), step):
            x, y = self._children(a[i : i + step], b[i : i + step], self.leaf, len(self.order))
            keep = x < y
            yield self.order[x[keep]], self.order[y[keep]]

    @staticmethod
    def _children(a, b, fanout, n):
        f = np.arange(fanout)
        x = np.repeat(a[:, None] * fanout + f, fanout, 1).ravel()
        y = np.tile(b[:, None] * fanout + f, fanout).ravel()
        keep = (x <= y) & (x < n) & (y < n)
        return x[keep], y[keep]

    @staticmethod
    def _may(level, x, y, share, threshold):
        # a pair of sizes p, q needs an overlap of share * (p + q), and p >= threshold * q
        top, lo, hi, t0, t1 = level
        may = (hi[x] >= threshold * lo[y] - 1e-9) & (hi[y] >= threshold * lo[x] - 1e-9)
        may &= ~((t0[x] == t1[x]) & (t0[y] == t1[y]) & (t0[x] == t0[y]) & (t0[x] != 0))
        at = np.flatnonzero(may)
        bound = np.minimum(top[x[at]], top[y[at]]).sum(1, dtype=np.int64)
        may[at] = bound + 1e-6 >= share * (lo[x[at]] + lo[y[at]])
        return may


#: Columns of block rows: n-gram, the block's chunks (0 if it is whole), 96 bits of the class, own chunk, size, place, n-grams before, point.
_KINDS = {"gram": "u8", "sub": "u8", "hi": "u8", "lo": "u4", "own": "u4", "size": "u4", "place": "u4"} | {f"last{i}": "u8" for i in range(LAST)} | {f"point{i}": "u4" for i in range(GROUPS)}
_CHUNKS = 1 << 20  # chunks of one block, at most


def _block_rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The rows that a batch of features sends to its blocks."""
    k = batch.column("n_blocks").to_numpy()
    batch, k = batch.take(pa.array(np.flatnonzero(k))), k[k > 0]
    flat = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
    gram, cls, point = flat("grams", _U), flat("cls", _U).reshape(-1, 2), flat("point", np.uint32).reshape(-1, GROUPS)
    own = np.repeat(np.arange(len(k)), k)
    inside = np.arange(len(gram)) - np.repeat(np.cumsum(k) - k, k)
    rows = {"gram": gram, "sub": np.zeros(len(gram), _U), "hi": cls[own, 0], "lo": (cls[:, 1] >> _U(32)).astype(np.uint32)[own], "own": np.zeros(len(gram), np.uint32)}
    rows |= {"size": batch.column("size").to_numpy().astype(np.uint32)[own], "place": flat("places", np.uint32)}
    for i in range(LAST):
        rows[f"last{i}"] = np.where(inside > i, np.roll(gram, i + 1), _U(0))
    return rows | {f"point{i}": point[own, i] for i in range(GROUPS)}


def _cut_hot(rows: dict[str, np.ndarray], codes: np.ndarray, hot: int) -> dict[str, np.ndarray]:
    """Rows of blocks that may hold more than ``hot`` sets go to a block for each pair of chunks with their own."""
    chunks = np.minimum(np.ceil(2.0 ** (codes / 4.0) / hot), _CHUNKS).astype(np.int64)
    many = np.flatnonzero(chunks > 1)
    if not len(many):
        return rows
    k = chunks[many]
    other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    mine = np.repeat((mix(rows["hi"][many]) % k.astype(_U)).astype(np.int64), k)
    cut = {c: v[np.repeat(many, k)] for c, v in rows.items()}
    cut["sub"] = (np.minimum(mine, other) * _CHUNKS + np.maximum(mine, other) + 1).astype(_U)
    cut["own"] = mine.astype(np.uint32)
    rest = np.flatnonzero(chunks == 1)
    return {c: np.concatenate([v[rest], cut[c]]) for c, v in rows.items()}


class _Blocks:
    """Block rows of one task: sorted by block, each class once in it."""

    def __init__(self, rows: dict[str, np.ndarray], threshold: float):
        order = np.lexsort((rows["lo"], rows["hi"], rows["sub"], rows["gram"]))
        name = [rows[c][order] for c in ("gram", "sub", "hi", "lo")]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in name])
        order = order[new]
        self.gram, self.sub, self.hi, self.lo, self.own = (rows[c][order] for c in ("gram", "sub", "hi", "lo", "own"))
        self.size, self.place = (rows[c][order].astype(np.int64) for c in ("size", "place"))
        self.last = np.stack([rows[f"last{i}"][order] for i in range(LAST)], 1)
        self.point = np.stack([rows[f"point{i}"][order] for i in range(GROUPS)], 1)
        # in a block of two chunks only rows of different ones meet
        self.whole = (self.sub == 0) | ((self.sub - _U(1)) // _U(_CHUNKS) == (self.sub - _U(1)) % _U(_CHUNKS))
        self.threshold, self.share = threshold, threshold / (1 + threshold)
        change = np.ones(len(order), bool)
        change[1:] = (self.gram[1:] != self.gram[:-1]) | (self.sub[1:] != self.sub[:-1])
        self.start = np.flatnonzero(change)
        self.rows = np.diff(np.append(self.start, len(order)))

    def pairs(self):
        """Index pairs that no bound rules out, in parts; blocks of one leaf are compared many at once."""
        for m in np.unique(self.rows[(self.rows > 1) & (self.rows <= LEAF)]).tolist():
            start = self.start[self.rows == m]
            i, j = np.triu_indices(m, 1)
            step = max(1, (1 << 19) // len(i))
            for s in range(0, len(start), step):
                part = start[s : s + step, None]
                yield self._allowed((part + i).ravel(), (part + j).ravel())
        for s, m in zip(self.start[self.rows > LEAF].tolist(), self.rows[self.rows > LEAF].tolist()):
            # rows of chunks that are compared within one tree may not be told apart by their tags
            tag = self.last[s : s + m, 0]
            for x, y in RTree(self.point[s : s + m], self.size[s : s + m], tag).join(self.threshold):
                yield self._allowed(x + s, y + s)

    def _allowed(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = self.size[x], self.size[y]
        # if this n-gram is the first shared one, the overlap is in what both have from it on
        keep = _fits(p, q, self.place[x], self.place[y], self.threshold) & (self.whole[x] | (self.own[x] != self.own[y]))
        x, y, need = x[keep], y[keep], self.share * (p + q)[keep] - 1e-6
        met = np.zeros(len(x), bool)
        for i in range(LAST):
            for j in range(LAST):
                met |= (self.last[x, i] == self.last[y, j]) & (self.last[x, i] != 0)
        x, y, need = x[~met], y[~met], need[~met]
        keep = np.minimum(self.point[x], self.point[y]).sum(1, dtype=np.int64) >= need
        return x[keep], y[keep]


def _bytes(names: np.ndarray) -> pa.Array:
    """Names of 16 bytes as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.arange(len(names) + 1, dtype=np.int32) * 16), pa.py_buffer(names.tobytes())])


def candidates(every: DataFrame, frequency: Table, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """``a, b``: pairs of classes, by name, that the trees can't rule out, each at least once, the lesser first."""
    parts = max(1, -(-(every.agg(F.sum("n_blocks")).first()[0] or 0) // PART_ROWS))

    def send(batches):
        table = frequency.again()
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                rows = _block_rows(batch.slice(a, 4096))
                rows = _cut_hot(rows, table.get(rows["gram"])[0], hot)
                part = (mix(rows["gram"] ^ mix(rows["sub"])) % _U(parts)).astype(np.int64)
                order = np.lexsort((rows["gram"], part))
                edge = np.flatnonzero(np.diff(part[order], prepend=-1))
                blobs = [_planes(*(rows[c][at].astype(kind) for c, kind in _KINDS.items())) for at in np.split(order, edge[1:]) if len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(part[order][edge]), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def join(batches):
        for blobs in _by_part(batches):
            found = [_columns(b, *_KINDS.values()) for b in blobs]
            rows = {c: np.concatenate([f[i] for f in found]) for i, c in enumerate(_KINDS)}
            del found
            blocks = _Blocks(rows, threshold)
            held, size = [], 0
            for x, y in blocks.pairs():
                held.append((x, y))
                size += len(x)
                if size > 1 << 18:
                    yield _batch(blocks, held)
                    held, size = [], 0
            if size:
                yield _batch(blocks, held)
            give_back()

    sent = every.where("n_blocks > 0").select("cls", "size", "n_blocks", "point", "grams", "places").mapInArrow(send, "part long, blob binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(join, "a long, b long")


def _by_part(batches):
    """The blobs of each part, of rows sorted by part."""
    now, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if part != now and held:
                yield held
                held = []
            now = part
            held.append(blob.as_py())
    if held:
        yield held


def _batch(blocks: _Blocks, held: list) -> pa.RecordBatch:
    x, y = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    a, b = blocks.hi[x].view(np.int64), blocks.hi[y].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


# --- verification ---


def gather(pairs: DataFrame, folder: str, most: int = HOT) -> DataFrame:
    """``block, a, b``: each pair with the gathering in which it is verified, of at most about 2 * ``most`` sets."""
    # from a set to its least neighbour, and on from there: most of a dense group meets at one; where a pair goes hangs on
    # its lesser set alone, so that a table of sets goes from step to step, not all pairs
    low = pairs.groupBy("b").agg(F.min("a").alias("home"))
    for step in range(STEPS):
        low = materialize(low.withColumnRenamed("b", "a"), folder, f"home{step}")
        home = pairs.join(low, "a", "left").select("a", "b", F.coalesce("home", "a").alias("home"))
        low = home.groupBy("b").agg(F.min("home").alias("home"))
    sets = home.select("home", F.col("a").alias("name")).unionByName(home.select("home", F.col("b").alias("name"))).distinct().groupBy("home").agg(F.count("*").alias("n"))
    large = sets.where(F.col("n") > most).select("home", F.ceil(F.col("n") / most).alias("chunks"))
    chunk = lambda c: F.pmod(F.xxhash64(c), F.coalesce("chunks", F.lit(1)))
    return home.join(large, "home", "left").select(F.xxhash64("home", F.least(chunk("a"), chunk("b")), F.greatest(chunk("a"), chunk("b"))).alias("block"), "a", "b")


class _Sketches:
    """Sketches of a gathering, by half a name."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, sketches: list[bytes]):
        order = np.argsort(names, kind="stable")
        self.names, self.size = names[order], sizes[order].astype(np.int64)
        self.rows = [np.frombuffer(sketches[i], np.uint64) for i in order]
        self.words = np.array([len(r) for r in self.rows])
        same = self.names[1:] == self.names[:-1]
        self.twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])

    def may(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the sketches let a pair reach the threshold; a name that two classes have always may."""
        i, j = np.searchsorted(self.names, a), np.searchsorted(self.names, b)
        out = self.twice[i] | self.twice[j]
        width = np.minimum(self.words[i], self.words[j])
        for w in np.unique(width[~out]).tolist():
            at = np.flatnonzero((width == w) & ~out)
            step = max(1, min(1 << 16, (4 << 20) // w))
            for s in range(0, len(at), step):
                part = at[s : s + step]
                held, place = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
                bits = np.stack([self.rows[k] if len(self.rows[k]) == w else np.bitwise_or.reduce(self.rows[k].reshape(-1, w), 0) for k in held])
                x, y = place[: len(part)], place[len(part) :]
                size = self.size[held]
                hidden = size - np.bitwise_count(bits).sum(1, dtype=np.int64)  # n-grams that have no bit of their own
                both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(hidden[x], hidden[y])
                out[part] = both >= threshold / (1 + threshold) * (size[x] + size[y]) - 1e-6
        return out


def sift(pairs: DataFrame, every: DataFrame, threshold: float) -> DataFrame:
    """``block, a, b``: the gathered pairs that their sketches, which travel to a gathering once each, can't rule out."""
    ends = pairs.select("block", F.col("a").alias("name")).unionByName(pairs.select("block", F.col("b").alias("name"))).distinct()
    known = every.where("n_blocks > 0").select("name", "cls", "size", "sketch").repartition("name").dropDuplicates(["name", "cls"])
    none = F.lit(None)
    rows = ends.join(known, "name").select("block", none.cast("long").alias("a"), none.cast("long").alias("b"), "name", "size", "sketch")
    todo = rows.unionByName(pairs.select("block", "a", "b", none.cast("long").alias("name"), none.cast("int").alias("size"), none.cast("binary").alias("sketch")))

    def work(batches):
        now, held, found = None, [], None
        for batch in batches:
            block = batch.column(0).to_numpy()
            is_pair = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (is_pair[1:] != is_pair[:-1])) + 1, [len(block)]]).tolist()
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if block[s] != now:
                    now, held, found = block[s], [], None
                part = batch.slice(s, e - s)
                if not is_pair[s]:
                    held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_pylist()))
                    continue
                if found is None:
                    found = _Sketches(*(np.concatenate([h[i] for h in held]) for i in (0, 1)), [x for h in held for x in h[2]])
                keep = found.may(part.column(1).to_numpy(), part.column(2).to_numpy(), threshold)
                yield part.select(["block", "a", "b"]).filter(pa.array(keep))

    return todo.repartition("block").sortWithinPartitions("block", F.col("a").asc_nulls_first(), "b").mapInArrow(work, "block long, a long, b long")


def verify(pairs: DataFrame, every: DataFrame, reps: DataFrame, docs: DataFrame, folder: str, n: int = NGRAM, threshold: float = THRESHOLD, *, forest: bool = False, most: int = HOT) -> DataFrame:
    """``a, b, jaccard`` of the candidate pairs that reach the threshold, compared as sets of 64-bit n-grams.

    With ``forest``, instead of all links: ``a, b`` of as many as connect what they
    connect in a gathering, and ``a, n`` (b is null), the number of a's links there. A gathering's texts
    travel to it once each, with its pairs behind them; a Bloom filter keeps texts that
    are in no pair out of the shuffle.
    """
    pairs = materialize(gather(pairs, folder, most), folder, "gathered")
    pairs = materialize(sift(pairs, every, threshold), folder, "sifted")
    ends = pairs.select("block", F.col("a").alias("name")).unionByName(pairs.select("block", F.col("b").alias("name"))).distinct()
    ends = materialize(ends.join(reps.select("name", "cls", "m.k1", "m.k2"), "name").drop("name"), folder, "ends")
    level = bloom(ends.select(F.col("k1").alias("a"), F.col("k2").alias("b")).distinct(), ends.count(), 0.02, f"{folder}/wanted")
    texts = docs.where("text is not null").select(*row_keys("doc_id", "text"), "text")
    texts = texts.where(level.column(F.col("k1"), F.col("k2"))).dropDuplicates(["k1", "k2"])
    none = F.lit(None)
    rows = ends.join(texts, ["k1", "k2"]).select("block", none.cast("long").alias("a"), none.cast("long").alias("b"), "cls", "text")
    todo = rows.unionByName(pairs.select("block", "a", "b", none.cast("binary").alias("cls"), none.cast("string").alias("text")))

    def work(batches):
        grams = _Grams(n)
        now, names, sets, bits, trees = None, [], [], None, None
        for batch in batches:
            block, texts = batch.column(0).to_numpy(), batch.column(4)
            is_pair = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (is_pair[1:] != is_pair[:-1])) + 1, [len(block)]]).tolist()
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if block[s] != now:
                    if trees is not None:
                        yield trees.rows(bits.names)
                    now, names, sets, bits, trees = block[s], [], [], None, None
                if not is_pair[s]:
                    part = texts[s:e]
                    for x, y in arrow_slices(part, 1 << 20, SLICE_BYTES):
                        flat, sizes = grams.many(part[x:y].to_pylist())
                        sets += np.split(flat, np.cumsum(sizes)[:-1])
                    names.append(_fixed(batch.column(3)[s:e]))
                    continue
                if bits is None:
                    bits = _Bits(np.concatenate(names), sets)
                i, j, jaccard = bits.links(batch.column(1)[s:e].to_numpy(), batch.column(2)[s:e].to_numpy(), threshold)
                if forest:
                    trees = trees or _Forest(len(bits.names))
                    trees.add(i, j)
                else:
                    yield pa.RecordBatch.from_arrays([_bytes(bits.names[i]), _bytes(bits.names[j]), pa.array(jaccard)], names=["a", "b", "jaccard"])
        if trees is not None:
            yield trees.rows(bits.names)

    sized = todo.repartition("block").sortWithinPartitions("block", F.col("a").asc_nulls_first(), "b")
    return sized.mapInArrow(work, "a binary, b binary, n long" if forest else "a binary, b binary, jaccard double")


class _Forest:
    """Links of a gathering: how many each set has, and as many as connect it."""

    def __init__(self, sets: int):
        self.root, self.n, self.kept = np.arange(sets), np.zeros(sets, np.int64), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.n += np.bincount(i, minlength=len(self.n)) + np.bincount(j, minlength=len(self.n))
        for s in range(0, len(i), 65536):
            a, b = i[s : s + 65536], j[s : s + 65536]
            while len(at := np.flatnonzero(self.root[a] != self.root[b])):
                a, b = a[at], b[at]
                low, high = np.minimum(self.root[a], self.root[b]), np.maximum(self.root[a], self.root[b])
                high, first = np.unique(high, return_index=True)
                self.root[high] = low[first]  # each root goes below a lesser one
                self.kept.append((a[first], b[first]))
                while (self.root[self.root] != self.root).any():
                    self.root = self.root[self.root]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(self.n)
        a, b = (np.concatenate([k[x] for k in self.kept] or [np.empty(0, np.int64)]) for x in (0, 1))
        return pa.RecordBatch.from_arrays(
            [_bytes(names[np.concatenate([a, at])]), pa.concat_arrays([_bytes(names[b]), pa.nulls(len(at), pa.binary())]), pa.array([None] * len(a) + self.n[at].tolist(), pa.int64())],
            names=["a", "b", "n"],
        )


def _fixed(names: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(names.to_pylist()), "V16")


class _Bits:
    """Sets of a block as rows of bits over the n-grams that at least two of them hold."""

    def __init__(self, names: np.ndarray, sets: list[np.ndarray]):
        half = names.view(np.int64)[::2]
        self.order = np.argsort(half, kind="stable")
        self.names, self.half = names[self.order], half[self.order]
        self.size = np.array([len(x) for x in sets])[self.order]
        flat = np.concatenate([sets[i] for i in self.order])
        owner = np.repeat(np.arange(len(sets)), self.size)
        at = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[at][1:] != flat[at][:-1]
        twice = ~new
        twice[:-1] |= ~new[1:]
        column = np.cumsum(new & twice) - 1  # numbers of the shared n-grams
        columns = int(column[-1]) + 1 if len(column) else 0
        self.row, self.column = owner[at][twice], column[twice]
        self.words = -(-columns // 64) or 1
        self.parts = max(1, -(-len(sets) * self.words * 8 // (64 << 20)))  # a wide block goes in strips of columns

    def links(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index pairs of those pairs (by half a name) that reach the threshold, and their Jaccard similarities.

        Should two classes agree in half their names, each is tried.
        """
        i, j = np.searchsorted(self.half, a), np.searchsorted(self.half, b)
        if (self.half[1:] == self.half[:-1]).any():
            p, q = np.searchsorted(self.half, a, "right") - i, np.searchsorted(self.half, b, "right") - j
            pair = np.repeat(np.arange(len(a)), p * q)
            inside = np.arange(len(pair)) - np.repeat(np.cumsum(p * q) - p * q, p * q)
            i, j = i[pair] + inside // q[pair], j[pair] + inside % q[pair]
            i, j = i[i < j], j[i < j]
        both = self.overlap(i, j)
        jaccard = both / (self.size[i] + self.size[j] - both)
        keep = jaccard >= threshold
        return i[keep], j[keep], jaccard[keep]

    def overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        width = -(-self.words // self.parts)
        for p in range(self.parts):
            bits = self._strip(p, width)
            step = max(1, (8 << 20) // (8 * width))
            for s in range(0, len(i), step):
                out[s : s + step] += np.bitwise_count(bits[i[s : s + step]] & bits[j[s : s + step]]).sum(1, dtype=np.int64)
        return out

    def _strip(self, p: int, width: int) -> np.ndarray:
        if self.parts == 1 and hasattr(self, "_all"):
            return self._all
        bits = np.zeros((len(self.names), width), np.uint64)
        on = (self.column >= p * width * 64) & (self.column < (p + 1) * width * 64)
        c = self.column[on] - p * width * 64
        np.bitwise_or.at(bits, (self.row[on], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        if self.parts == 1:
            self._all = bits
        return bits


# --- classes and groups ---


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, hot: int = HOT, *, forest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Distinct rows (``k1, k2, doc_id, cls, name, n``), classes (``cls, name, m, members``), links of classes (see verify), and their folder.

    ``m`` is the row that stands for a class: the least by id (nulls last), then key.
    """
    folder = shared_dir(docs.sparkSession)
    texts = docs.where("text is not null").select("text")
    ranges = _Ranges(texts)
    frequency = frequencies(texts, ranges, n, f"{folder}/frequency")
    partners = with_partners(texts, ranges, frequency, n, threshold, f"{folder}/partners")
    every = materialize(features(docs, frequency, partners, n, threshold), folder, "features")
    rows = every.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("cls").alias("cls"), F.first("name").alias("name"), F.count("*").alias("n"))
    rows = materialize(rows, folder, "rows")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2"))
    reps = materialize(rows.where("cls is not null").groupBy("cls", "name").agg(least.alias("m"), F.count("*").alias("members")), folder, "classes")
    pairs = materialize(candidates(every, frequency, threshold, hot).distinct(), folder, "pairs")
    return rows, reps, materialize(verify(pairs, every, reps, docs, folder, n, threshold, forest=forest, most=hot), folder, "links"), folder


def similar_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """``doc_a, doc_b, jaccard``: pairs of classes at or above the threshold, by the ids that stand for them, smaller first."""
    _, reps, links, _ = similar_sets(docs, n, threshold, hot)
    left, right = (reps.select(F.col("cls").alias(k), F.col("m.doc_id").alias(f"{k}_id")) for k in ("a", "b"))
    first = F.col("b_id").isNull() | (F.col("a_id") <= F.col("b_id"))
    ids = links.join(left, "a").join(right, "b")
    return ids.select(F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("doc_a"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))


def _grouped(docs: DataFrame, n: int, threshold: float, hot: int) -> tuple[DataFrame, DataFrame, str]:
    """Distinct rows, and by class: ``best`` (the row that stands for its group), members, links."""
    rows, reps, links, folder = similar_sets(docs, n, threshold, hot, forest=True)
    roots = components(links.where("b is not null").select("a", "b"), folder)
    inside = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    inside = inside.join(reps, inside["node"] == reps["cls"]).select("cls", "root", "m")
    best = inside.groupBy("root").agg(F.min("m").alias("best"))
    number = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    known = inside.join(best, "root").select("cls", "best").join(number, "cls")
    classes = reps.join(known, "cls", "left").select("cls", F.coalesce("best", "m").alias("best"), "members", F.coalesce("links", F.lit(0)).alias("links"))
    return rows, classes, folder


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """``doc_id, class_id, n_copies, n_links`` of every document: its group, and with whom it is linked.

    ``n_copies`` is the number of other documents with the same set of n-grams, ``n_links``
    that of other sets at or above the threshold (each counts once, however many
    documents have it); ``class_id`` is the least id of all documents that such
    links, in one step or several, connect with it. A row repeated in full is one
    document. Null ids are last: a group without any other id has a null one. Null texts
    and texts without words are alone; a text with fewer words than ``n`` is one short
    n-gram. Ids may be of any type that can be ordered. Other columns are ignored; an
    empty table gives an empty result. ``similar_pairs`` lists the links themselves.
    """
    rows, classes, _ = _grouped(docs, n, threshold, hot)
    out = rows.join(classes, "cls", "left")
    mine = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("doc_id", mine.alias("class_id"), (F.coalesce("members", F.lit(1)) - 1).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node, root`` of every node in ``edges`` (``a, b``): the least key that it is connected with.

    Alternates large-star and small-star steps, each written to the shared folder, until
    none changes an edge; rounds grow with the logarithm of the longest chain.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "edges0")
    step, before = 0, None
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, folder, f"large{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = materialize(small, folder, f"small{step}")
        after = small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, before = small, after


def drop_near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each group of similar documents: a connected part of the links.

    The least (doc_id, nulls last, key) of a group stays; of rows repeated in full one
    stays. Rows without text or words are kept, all of them. All columns stay. Only rows
    that a Bloom filter takes for lost or repeated are shuffled.
    """
    rows, classes, folder = _grouped(docs, n, threshold, hot)
    lost = (F.col("k1") != F.col("best.k1")) | (F.col("k2") != F.col("best.k2"))
    care = materialize(rows.where("cls is not null").join(classes, "cls").select("k1", "k2", lost.alias("lost"), "n").where("lost or n > 1").select("k1", "k2", "lost"), folder, "care")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys("doc_id", "text"))
    if not (many := care.count()):
        return row.select("row.*")
    hit = bloom(care.select(F.col("k1").alias("a"), F.col("k2").alias("b")), many, 0.02, f"{folder}/cared").column(F.col("k1"), F.col("k2"))
    known = row.where(hit).join(care, ["k1", "k2"], "left")
    again = known.where("not lost").groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return row.where(~hit).select("row.*").unionByName(known.where("lost is null").select("row.*")).unionByName(again.select("row.*"))


ORACLE = f"""
with recursive w as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') k from (select distinct doc_id, text from documents)),
g as (
  select doc_id, list_sort(list_distinct(case when len(k) < {NGRAM} then [array_to_string(k, ' ')]
    else list_transform(range(1, len(k) - {NGRAM} + 2), lambda i: array_to_string(k[i : i + {NGRAM} - 1], ' ')) end)) s
  from w where len(k) > 0),
c as (select s, min(doc_id) rep, list(doc_id) members, len(s) size from g group by s),
i as (select rep, size, unnest(s) x from c),
o as (select a.rep a, b.rep b, a.size p, b.size q, count(*) n from i a join i b on a.x = b.x and a.rep < b.rep group by all),
e as (select a, b from o where n / (p + q - n) >= {THRESHOLD} union all select b, a from o where n / (p + q - n) >= {THRESHOLD}),
near(node, id) as (select distinct a, a from e union select e.b, near.id from near join e on e.a = near.node),
least as (select node, min(id) id from near group by node),
links as (select a, count(*) n from e group by a),
of_rep as (select rep, members, coalesce(least.id, rep) class_id, coalesce(links.n, 0) n_links from c left join least on node = rep left join links on a = rep),
found as (select unnest(members) doc_id, class_id, len(members) - 1 n_copies, n_links from of_rep)
select w.doc_id, coalesce(f.class_id, w.doc_id) class_id, cast(coalesce(f.n_copies, 0) as bigint) n_copies, cast(coalesce(f.n_links, 0) as bigint) n_links
from w left join found f using (doc_id)"""
