"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Items are rotated by the right singular vectors of the whole table, sorted by
descending length and packed into blocks in the shared folder. A task holds panels of
queries and streams the blocks in that order; it stops once (length of query) x (longest
item left) can't reach its k-th score, and passes over a block, unread, whose greatest
leading and residual lengths can't. Inside a block the products over the leading rotated
coordinates come first; by Cauchy-Schwarz the rest adds at most the product of the
residual lengths, and only pairs that may still enter get their full product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import get_blob, put_blob, shared_dir

K = 10
#: Items of a block; queries worked on at once; leading coordinates of the partial product.
BLOCK, QUERIES, HEAD = 2048, 2048, 24
#: The queries of a corpus: every row whose id is divisible by this.
EVERY = 100
#: Groups in which tasks' Gram matrices are added up before the driver has them.
SUMS = 32
#: Rounding slack of the bounds, relative to the product of lengths.
SLACK = 1e-9


def _valid(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the whole table, greatest first, from its dim x dim Gram matrix."""

    def gram(batches):
        from pyspark import TaskContext

        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS]), pa.array([total.tobytes()])], names=["at", "g"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [sum(np.frombuffer(g) for g in pdf["g"]).tobytes()]})

    # a matrix a task, added up in groups, so that no more than SUMS of them reach the driver
    cells = rows.select("v").mapInArrow(gram, "at long, g binary").groupBy("at").applyInPandas(add, "g binary").collect()
    g = sum((np.frombuffer(c["g"]) for c in cells), np.zeros(dim * dim))
    return np.ascontiguousarray(np.linalg.eigh(g.reshape(dim, dim))[1][:, ::-1])


def _pack(rows: DataFrame, rot: np.ndarray, folder: str) -> list[tuple[str, int, float, float, float]]:
    """Write norm-sorted blocks; the manifest (file, items, greatest length, of the leading part, of the rest) in order."""
    dim, block = rot.shape[0], BLOCK
    head = min(HEAD, dim)
    by_length = rows.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).orderBy(F.desc("n"), "id")

    def work(batches):
        from pyspark import TaskContext

        part, held, k = TaskContext.get().partitionId(), [], 0

        def flush(ids, x, n):
            nonlocal k
            name = f"items/{part:07d}-{k:07d}"
            r = x @ rot
            put_blob(f"{folder}/{name}", ids.tobytes() + n.tobytes() + x.tobytes() + r.tobytes())
            k += 1
            ends = [float(np.sqrt((p * p).sum(1)).max(initial=0)) for p in (r[:, :head], r[:, head:])]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int32()), *(pa.array([v]) for v in (float(n[0]), *ends))], names=["name", "n", "longest", "lead", "rest"])

        ids, x, n = np.empty(0, np.int64), np.empty((0, dim)), np.empty(0)
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            x = np.concatenate([x, _matrix(batch.column(1))])
            n = np.concatenate([n, batch.column(2).to_numpy()])
            while len(ids) >= block:
                yield flush(ids[:block], x[:block], n[:block])
                ids, x, n = ids[block:], x[block:], n[block:]
        if len(ids):
            yield flush(ids, x, n)

    return sorted(tuple(r) for r in by_length.mapInArrow(work, "name string, n int, longest double, lead double, rest double").collect())


def search_block(qid, q, qr, qn, best_s, best_i, ids, n, x, xr, k, head=HEAD):
    """Merge one block into the queries' best scores and ids (both queries x k, best first)."""
    head = min(head, q.shape[1])
    tail_q = np.sqrt(np.maximum(0, (qr[:, head:] ** 2).sum(1)))
    tail_x = np.sqrt(np.maximum(0, (xr[:, head:] ** 2).sum(1)))
    slack = SLACK * (qn * n[0] + 1e-300)
    kth = best_s[:, -1] - slack
    part = qr[:, :head] @ xr[:, :head].T
    may = part + np.outer(tail_q, tail_x) >= kth[:, None]
    rows = np.flatnonzero(may.any(1))
    if not len(rows):
        return best_s, best_i
    cols = np.flatnonzero(may[rows].any(0))
    full = part[np.ix_(rows, cols)] + qr[rows, head:] @ xr[cols, head:].T
    full[ids[cols][None, :] == qid[rows][:, None]] = -np.inf
    if full.shape[1] > k:  # no pair below the block's own k-th can enter
        own = -np.partition(-full, k - 1, axis=1)[:, k - 1]
        kth = np.maximum(kth[rows], own - slack[rows])
    else:
        kth = kth[rows]
    r, c = np.nonzero((full >= kth[:, None]) & (full > -np.inf))
    if not len(r):
        return best_s, best_i
    exact = np.einsum("ij,ij->i", q[rows[r]], x[cols[c]])
    at = np.concatenate([np.repeat(np.arange(len(q)), k), rows[r]])
    s = np.concatenate([best_s.ravel(), exact])
    i = np.concatenate([best_i.ravel(), ids[cols[c]]])
    order = np.lexsort((i, -s, at))
    at, s, i = at[order], s[order], i[order]
    start = np.searchsorted(at, np.arange(len(q)))
    take = start[:, None] + np.arange(k)[None, :]
    return s[take], i[take]


def top_k(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, queries: Column | None = None) -> DataFrame:
    """``query_id, rank, item_id, score``: the k greatest inner products of the queries with all rows.

    ``queries`` is a condition on the column ``id``; by default every row is a query.
    Items with the query's own id are left out; equal scores go by the smaller item id.
    A row counts as it stands, so a repeated row is a query and an item twice. Rows with
    a null id, or whose vector is null, empty or holds nulls, NaN or infinite values, are
    left out, as queries and as items; vectors of several dimensions are an error. Fewer
    than k items give fewer rows, an empty table none. Scores are rounded to 6 decimals
    after ranking. Other columns are ignored.

    Exact search compares all pairs that its bounds can't rule out; items are read block
    by block from the shared folder, so no task holds more than one block and no row
    is shuffled but for the sort by length.
    """
    rows = _valid(table, id_col, vec_col)
    spark = table.sparkSession
    schema = "query_id long, rank int, item_id long, score double"
    dims = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().limit(2).collect()]
    if not dims:
        return spark.createDataFrame([], schema)
    if len(dims) > 1:
        raise ValueError("vectors of several dimensions")
    dim = dims[0]
    rot = rotation(rows, dim)
    folder = shared_dir(spark)
    manifest = spark.sparkContext.broadcast(_pack(rows, rot, folder))

    def work(batches):
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for a in range(0, len(ids), QUERIES):
                yield _answer(ids[a : a + QUERIES], x[a : a + QUERIES], rot, folder, manifest.value, k)

    return (rows if queries is None else rows.where(queries)).mapInArrow(work, schema)


def _answer(qid, q, rot, folder, manifest, k):
    dim = rot.shape[0]
    qr, qn = q @ rot, np.sqrt((q * q).sum(1))
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    lead, rest = (np.sqrt((p * p).sum(1)) for p in (qr[:, : min(HEAD, dim)], qr[:, min(HEAD, dim) :]))
    for name, n, longest, item_lead, item_rest in manifest:
        live = live[qn[live] * longest * (1 + SLACK) >= best_s[live, -1]]
        if not len(live):
            break
        may = (lead[live] * item_lead + rest[live] * item_rest) * (1 + SLACK) >= best_s[live, -1]
        every, live = live, live[may]  # the others may come back for a later block
        if not len(live):
            live = every
            continue
        raw = get_blob(f"{folder}/{name}")
        ids = raw[: 8 * n].view(np.int64)
        norms = raw[8 * n : 16 * n].view(np.float64)
        x = raw[16 * n : (16 + 8 * dim) * n].view(np.float64).reshape(n, dim)
        xr = raw[(16 + 8 * dim) * n :].view(np.float64).reshape(n, dim)
        best_s[live], best_i[live] = search_block(qid[live], q[live], qr[live], qn[live], best_s[live], best_i[live], ids, norms, x, xr, k)
        live = every
    found = best_s > -np.inf
    rank = np.broadcast_to(np.arange(1, k + 1), found.shape)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(qid, found.sum(1))), pa.array(rank[found], pa.int32()), pa.array(best_i[found]), pa.array(np.round(best_s[found], 6))],
        names=["query_id", "rank", "item_id", "score"],
    )


ORACLE = f"""
with e as (select vec_id, embedding::double[] v from embeddings),
s as (select a.vec_id query_id, b.vec_id item_id, list_inner_product(a.v, b.v) score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0)
select query_id, cast(rank as integer) rank, item_id, round(score, 6) score
from (select *, row_number() over (partition by query_id order by score desc, item_id) rank from s) where rank <= {K}"""
