"""Shared storage, tokens and hashes of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a Python task.
SLICE_BYTES = 4 << 20
MASK = (1 << 64) - 1
_WORD = re.compile(r"[^\W_]+")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach.

    Where the session names none (tests, one machine), a temporary folder is set.
    The folder is removed when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tiltfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tiltfield-{uuid.uuid4().hex}"
    _OPEN.append(path)
    if len(_OPEN) == 1:
        atexit.register(release, spark)
    return path


#: Folders that were handed out and not yet removed.
_OPEN: list[str] = []


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove folders (all that are open, if not named), once nothing reads their tables."""
    for path in list(_OPEN if paths is None else paths):
        if path in _OPEN:
            _OPEN.remove(path)
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session ended first
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, one computation."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The POSIX path of a mounted folder, None for any other file system."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_blob(uri: str, data: bytes) -> None:
    """Write one file; a task that runs twice leaves the same whole file."""
    import os

    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
    part = f"{where}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, where)


def get_blob(uri: str) -> np.ndarray:
    """The bytes of one file, memory-mapped where the shared folder is mounted."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=np.uint8, mode="r")
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    with system.open_input_file(where) as f:
        return np.frombuffer(f.read_buffer(), dtype=np.uint8)


def row_key(*columns: str) -> Column:
    """Names a row by its content, so that null or repeated ids need no special case."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def row_keys(*columns: str) -> list[Column]:
    """``k1, k2``: 128 bits that name a row by its content, so that null or repeated ids need no special case."""
    parts = [F.struct(F.col(c).isNull(), F.col(c)) for c in columns]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((0x5EED, "k1"), (0xBEEF01, "k2"))]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return free memory of Arrow's pool and, where it can, of the C library: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)


class HashCache(dict):
    """token -> 64-bit hash, kept for at most ``limit`` tokens at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, token):
        if len(self) >= self.limit:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


@functools.lru_cache(maxsize=1)
def _letters_and_digits() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths of all texts' words (see words_of) on end; where each text's begin, and the end.

    All words at once, character by character: the k-th step takes in the k-th character of
    the words that are long enough.
    """
    low = [t.lower() for t in texts]
    flat = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(flat) + 2, np.int8)
    inside[1:-1] = _letters_and_digits()[flat]
    edge = np.diff(inside)
    first, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size -= first
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 65536 else size, kind="stable")[::-1]
    at, length = first[order], size[order]
    h = np.full(len(at), 0x51ED270B, np.uint64)
    shorter = -length
    for k in range(int(length[0]) if len(length) else 0):
        longer = int(np.searchsorted(shorter, -k))  # words of more than k characters
        h[:longer] = (h[:longer] ^ flat[at[:longer] + k]) * np.uint64(0x9E3779B97F4A7C15)
        h[:longer] ^= h[:longer] >> np.uint64(29)
    out = np.empty(len(at), np.uint64)
    out[order] = mix(h)
    begin = np.cumsum([0] + [len(t) + 1 for t in low])
    return out, size, np.searchsorted(first, begin)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(texts: list, limit: int = SLICE_BYTES):
    """(start, stop) of runs of texts of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def arrow_slices(texts: pa.Array, limit: int = SLICE_BYTES, back: int = 0):
    """The same over an Arrow column, before any text becomes an object.

    Memory that is free goes back after each slice, or each ``back`` bytes of text and at the end.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    start = given = 0
    upto = np.cumsum(size)
    while start < len(size):
        stop = min(len(size), int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit)) + 1)
        yield start, stop
        start = stop
        if stop == len(size) or upto[stop - 1] - given >= back:
            give_back()
            given = upto[stop - 1]
