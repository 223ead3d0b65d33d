"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_slices

#: Public pre-split pattern of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts longer than this are cut at safe boundaries before they reach the library.
CHUNK_CHARS = 1 << 16
#: A match of PATTERN that covers the left character ends there, and it has no
#: look-behind, so the rest splits as it would inside the whole text.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str = PATTERN):
    """The tiktoken encoding of a rank file (lines of base64 token and rank)."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK_CHARS):
    """Cut a text at the first safe boundary after each ``size`` characters."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None or m.start() >= len(text):
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str, ranks_path: str = RANKS, size: int = CHUNK_CHARS) -> list[int]:
    """Token ids of a text; ``size`` never changes them."""
    enc = encoding(ranks_path)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in chunks(text, size) for i in enc.encode_ordinary(part)]


def decode(ids, ranks_path: str = RANKS) -> bytes:
    """Raw bytes of token ids, which need not be whole characters."""
    return encoding(ranks_path).decode_bytes(list(ids))


SCHEMA = "doc_id long, tokens array<int>, n_tokens int, n_bytes long, decoded_ok boolean"


def encode_documents(docs: DataFrame, ranks_path: str = RANKS, chunk_chars: int = CHUNK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, tokens, n_tokens, n_bytes, decoded_ok`` for each row of ``docs``.

    Every row is encoded whole and decoded again; ``decoded_ok`` says that the bytes
    agree. A null text gives null in all but ``doc_id``, an empty one an empty list.
    Repeated rows and null ids are rows like others; the columns in ``keep`` follow as
    they are, others are ignored. An empty table gives an empty result. One narrow pass, no shuffle.
    """

    def work(batches):
        enc = encoding(ranks_path)
        for batch in batches:
            ids = batch.column(0)
            for a, b in arrow_slices(batch.column(1)):
                tokens, n, size, ok = [], [], [], []
                for text in batch.column(1)[a:b].to_pylist():
                    if text is None:
                        for out in (tokens, n, size, ok):
                            out.append(None)
                        continue
                    found = encode(text, ranks_path, chunk_chars)
                    raw = text.encode("utf-8")
                    tokens.append(np.array(found, dtype=np.int32))
                    n.append(len(found))
                    size.append(len(raw))
                    ok.append(enc.decode_bytes(found) == raw)
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(tokens, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array(ok, pa.bool_()), *(c[a:b] for c in batch.columns[2:])],
                    names=["doc_id", "tokens", "n_tokens", "n_bytes", "decoded_ok", *keep],
                )

    docs = docs.select("doc_id", "text", *keep)
    return docs.mapInArrow(work, ", ".join([SCHEMA, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)]))


def decode_tokens(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``doc_id, raw`` (binary): the bytes of each row's ``tokens``; null for null."""

    def work(batches):
        for batch in batches:
            raw = [None if t is None else decode(t, ranks_path) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "tokens").mapInArrow(work, "doc_id long, raw binary")
