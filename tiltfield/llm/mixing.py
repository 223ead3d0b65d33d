"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is put into one random order (by a hash), cut into blocks. Whole-number
block quotas meet the target weights. A binary tree over the output shards splits the
quota vector, at each node by one multivariate-hypergeometric draw, until each leaf has
its blocks of each source; leaves take successive runs of the permuted blocks, so no
block is drawn twice. Rows find their shard by comparing their hash with the runs'
bounds, so the texts are shuffled once, straight to their shard, and ordered there. The
bounds lie in the shared folder, one file a source, which tasks map.

The driver holds the tree's leaves (8 bytes a shard and source) and the counts of cells, into
which a source's order is cut (about CELL_ROWS rows each); both grow with rows / 16,384,
and with the number of sources, which is taken to be small (thousands).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import get_blob, put_blob, shared_dir

#: Rows of a block; rows that a shard aims at.
BLOCK_ROWS, SHARD_ROWS = 16, 16384
#: Rows that a cell of a source's order aims at.
CELL_ROWS = 65536
#: Blocks grow beyond so many, which the generator of hypergeometric numbers can't take.
MOST_BLOCKS = 900_000_000
SEED = 29


@dataclass(frozen=True)
class Plan:
    sources: tuple
    quotas: np.ndarray  # blocks of each source
    shards: np.ndarray  # shards x sources, blocks


def quotas(counts: np.ndarray, weights: np.ndarray, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Whole blocks of each source, at the target weights, as many as the scarcest source allows.

    A source whose last block is short keeps it as a block.
    """
    have = -(-counts // block_rows)
    wanted = weights > 0
    if not wanted.any():
        return np.zeros_like(have)
    share = weights / weights.sum()
    total = np.min(have[wanted] / share[wanted])
    return np.minimum(have, np.floor(share * total + 1e-9).astype(np.int64))


def split(quota: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard: shards x sources.

    Each node gives its left part a share in proportion to its shards, drawn without
    replacement from all its blocks; sums over shards are the quotas exactly, and the
    shards' totals differ by one block at most along each split.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quota)), dtype=np.int64)
    todo = [(0, shards, quota.astype(np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[a] = q
            continue
        mid = (a + b) // 2
        n = int(q.sum() * (mid - a) // (b - a))
        left, rest_n, rest = np.zeros_like(q), n, int(q.sum())
        for i, x in enumerate(q):  # one marginal after another
            rest -= int(x)
            left[i] = rng.hypergeometric(int(x), rest, rest_n) if rest_n and x else 0
            rest_n -= int(left[i])
        todo += [(mid, b, q - left), (a, mid, left)]
    return out


def _order(seed: int):
    return F.xxhash64(F.lit(seed), F.struct("doc_id"), F.struct("text"))


def make_plan(counts: dict, weights: dict | None = None, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> Plan:
    """Quotas and their tree for sources with ``counts`` rows; a source without a weight gets none.

    Without weights, sources keep their natural shares: all rows are drawn, however small one source is.
    """
    names = tuple(sorted(counts, key=lambda s: (s is None, s or "")))
    n = np.array([counts[s] for s in names], dtype=np.int64)
    block_rows = wide(n, block_rows)
    if weights is None or not len(n):
        q = -(-n // block_rows)
    else:
        q = quotas(n, np.array([weights.get(s, 0.0) for s in names], dtype=np.float64), block_rows)
    shards = max(1, -(-int(q.sum()) * block_rows // shard_rows)) if len(n) else 0
    return Plan(names, q, split(q, shards, seed) if shards else np.zeros((0, len(n)), np.int64))


def wide(counts: np.ndarray, block_rows: int) -> int:
    """Rows of a block: as many as wanted, doubled while there would be more than MOST_BLOCKS."""
    while (-(-counts // block_rows)).sum() > MOST_BLOCKS:
        block_rows *= 2
    return block_rows


def assign(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """``row`` (the whole input row as a struct), ``shard`` and ``pos_key`` of each drawn row.

    Null is a source like any other. Rows whose id and text are the same can't be told
    apart: a run's bound that falls among them moves behind the last. Other columns go along
    inside ``row``. Without rows or positive weights the result is empty.
    """
    return _assigned(docs, weights, block_rows, shard_rows, seed)[0]


def _assigned(docs: DataFrame, weights: dict | None, block_rows: int, shard_rows: int, seed: int) -> tuple[DataFrame, int]:
    """The rows of ``assign``, and the number of shards."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("s"), _order(seed).alias("h"))
    folder = shared_dir(docs.sparkSession)
    counts = {c.s: c.n for c in base.groupBy("s").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(counts, weights, block_rows, shard_rows, seed)
    places = _bounds(base.select("s", "h"), counts, plan, wide(np.array(list(counts.values()), np.int64), block_rows), folder)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("int")
    def shard_of(s: pd.Series, h: pd.Series) -> pd.Series:
        code, names = pd.factorize(s)  # null is -1
        hashes, result = h.to_numpy(), np.full(len(s), -1, np.int32)
        for k in np.unique(code):
            at, name = np.flatnonzero(code == k), None if k < 0 else names[k]
            if (i := shared.value.get(name)) is None:
                continue
            raw = get_blob(f"{folder}/bounds/{i}")
            runs = len(raw) // 12
            edges, shards = raw[: 8 * runs].view(np.int64), np.append(raw[8 * runs :].view(np.int32), -1)
            result[at] = shards[np.searchsorted(edges, hashes[at], side="left")]  # edges are last hashes of runs
        return pd.Series(result, index=s.index)

    # else the filter would be pushed below and the shard found twice, by two Python workers a task
    drawn = base.withColumn("shard", shard_of.asNondeterministic()("s", "h")).where("shard >= 0").select("row", "shard", F.xxhash64(F.lit(seed + 1), "h").alias("pos_key"))
    return drawn, len(plan.shards)


def _bounds(keys: DataFrame, counts: dict, plan: Plan, block_rows: int, folder: str) -> dict:
    """source -> number of its file: the last hash of each run in order, and the runs' shards.

    A run's last rank is looked up in its cell: cells are counted, and ranked one by one.
    """
    spark = keys.sparkSession
    order = {s: i for i, s in enumerate(plan.sources)}
    bits = {s: max(0, int(counts[s] // CELL_ROWS).bit_length()) for s in order}
    kind = keys.schema["s"].dataType.simpleString()
    if not order:
        return {}
    # Arrow tables, since rows and pandas frames would pass through a second set of Python workers, which stays
    names = pa.array(list(order), to_arrow_type(keys.schema["s"].dataType))
    known = spark.createDataFrame(pa.table({"s": names, "i": list(order.values()), "shift": [64 - bits[s] for s in order]}), f"s {kind}, i int, shift int")
    # as many rows as sources; a shift by 64 would be none
    cell = F.when(F.col("shift") < 64, F.expr("shiftright(h, shift)")).otherwise(F.lit(0).cast("long"))
    cells = keys.join(F.broadcast(known), keys["s"].eqNullSafe(known["s"])).select("i", cell.alias("b"), "h")
    sizes = cells.groupBy("i", "b").agg(F.count("*").alias("n")).toArrow().sort_by([("i", "ascending"), ("b", "ascending")])
    i, b, n = (sizes.column(c).to_numpy() for c in ("i", "b", "n"))
    asked, files = [], {}
    for k, s in enumerate(plan.sources):
        own = slice(*np.searchsorted(i, [k, k + 1]))
        upto = np.cumsum(n[own])
        shards = np.flatnonzero(plan.shards[:, k])
        if not len(shards) or not len(upto):
            continue
        ends = np.minimum(np.cumsum(plan.shards[shards, k]) * block_rows, counts[s])
        at = np.minimum(np.searchsorted(upto, ends), len(upto) - 1)
        asked.append(pd.DataFrame({"i": np.int32(k), "b": b[own][at], "r": ends - (upto - n[own])[at], "shard": shards.astype(np.int32)}))
        files[s] = k
    if not asked:
        return {}
    ask = spark.createDataFrame(pa.Table.from_pandas(pd.concat(asked), preserve_index=False), "i int, b long, r long, shard int")
    ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy("i", "b").orderBy("h")).cast("long"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["i"].iloc[0])
        pdf = pdf.sort_values("shard")
        put_blob(f"{folder}/bounds/{k}", pdf["h"].to_numpy(np.int64).tobytes() + pdf["shard"].to_numpy(np.int32).tobytes())
        return pd.DataFrame({"i": [k]})

    ranked.join(ask, ["i", "b", "r"]).select("i", "shard", "h").groupBy("i").applyInPandas(write, "i int").collect()
    return files


def mix_rows(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, shard, position, text`` of every drawn row; see ``assign``.

    ``position`` counts from 0 in a shard's own random order (by hash, then id and text).
    """
    drawn = assign(docs, weights, block_rows, shard_rows, seed).select("row.doc_id", "row.source", "shard", "row.text", "pos_key")
    w = Window.partitionBy("shard").orderBy("pos_key", "doc_id", "text")
    return drawn.withColumn("position", F.row_number().over(w) - 1).select("doc_id", "source", "shard", "position", "text")


def mixed_documents(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """The drawn rows with their own columns: partition k is shard k in its random order; see ``placed``."""
    drawn, shards = _assigned(docs, weights, block_rows, shard_rows, seed)
    return drawn.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("pos_key", "row.doc_id", "row.text").select("row.*")


def placed(mixed: DataFrame) -> DataFrame:
    """``doc_id, text, shard, position`` of ``mixed_documents`` that were written to parquet and read again.

    A shard is a file there, named by its partition; ``position`` is a row's place in it, from 0.
    Files that a writer cut (spark.sql.files.maxRecordsPerFile) are not put together.
    """
    meta = mixed.metadataColumn("_metadata")
    shard = F.regexp_extract(meta.getField("file_name"), r"^part-(\d+)", 1).cast("int")
    return mixed.select("doc_id", "text", shard.alias("shard"), meta.getField("row_index").alias("position"))
