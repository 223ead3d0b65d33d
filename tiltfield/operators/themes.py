"""Themes: clusters of the words nearest to a pole."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vecops import dot, literal, unit, unit_list
from .neighbors import filtered_neighbors


def silhouette(points: DataFrame) -> DataFrame:
    """One row: mean Euclidean silhouette of ``points(word, v, label)``; 0 for a point alone in its cluster."""
    a, b = points.select("word", F.col("v").alias("x"), F.col("label").alias("la")), points.select(F.col("word").alias("other"), F.col("v").alias("z"), F.col("label").alias("lb"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "z", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
    pairs = a.crossJoin(b).where("word <> other").select("word", "la", "lb", gap.alias("d"))
    mean = pairs.groupBy("word", "la", "lb").agg(F.avg("d").alias("d"))
    near = mean.groupBy("word").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("next"))
    s = F.when(F.col("own").isNull() | F.col("next").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("next") - F.col("own"), F.greatest("next", "own")), F.lit(0.0)))
    return near.agg(F.avg(s).alias("silhouette"))


def _lloyd(x: np.ndarray, k: int, seed: int, tries: int = 10) -> np.ndarray:
    rng, best, cost = np.random.default_rng(seed), None, np.inf
    for _ in range(tries):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(300):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            label = d.argmin(1)
            new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        now = d.min(1).sum()
        if now < cost - 1e-12:
            best, cost = label, now
    return best


def _score(x: np.ndarray, label: np.ndarray) -> float:
    d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2)))
    total = 0.0
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() < 2:
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][label == c].mean() for c in set(label) if c != label[i])
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(x)


def choose_labels(x: np.ndarray, k: int | None, k_min: int, k_max: int, seed: int) -> np.ndarray:
    """Cluster labels; without k, of the k with the strictly best silhouette."""
    if k is not None:
        return _lloyd(x, int(k), seed)
    best, top = None, -1.0
    for kk in range(max(2, k_min), max(2, min(k_max, max(k_min, len(x) - 1))) + 1):
        label = _lloyd(x, kk, seed)
        if len(set(label)) <= 1 or np.bincount(label).max() <= 1:
            continue
        s = _score(x, label)
        if s > top:
            best, top = label, s
    return best if best is not None else _lloyd(x, max(2, k_min), seed)


def cluster_labels(words: DataFrame, *, k: int | None = None, k_min: int = 2, k_max: int = 10, random_state: int = 13) -> DataFrame:
    """``word, v, label`` of ``words(word, v, place)``: k-means in one task, as the neighbours are few by design."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        if len(pdf) < max(2, k_min):
            raise ValueError("too few neighbours to cluster")
        return pdf.assign(label=choose_labels(np.stack(pdf["v"].to_numpy()), k, k_min, k_max, random_state))[["word", "v", "label"]]

    return words.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(work, "word string, v array<double>, label int")


def cluster_stats(points: DataFrame, direction: Sequence[float], *, side: str = "pos", min_cluster_size: int = 2, top_words: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters, members and centroids of ``points(word, v, label)`` with unit vectors.

    Centroids are unit means; cosines are with +direction on both sides. Ranks go down
    by it on the positive side and up on the other, ties by label.
    """
    bu = literal(unit_list(direction))
    centers = points.groupBy("label").agg(F.count("*").alias("size"), Summarizer.mean(array_to_vector("v")).alias("m")).where(F.col("size") >= min_cluster_size)
    centers = centers.select("label", "size", unit(vector_to_array("m")).alias("centroid")).withColumn("centroid_cos_beta", dot(F.col("centroid"), bu))
    order = F.desc("centroid_cos_beta") if side == "pos" else F.asc("centroid_cos_beta")
    # as many rows as clusters reach this window
    centers = centers.withColumn("cluster_rank", F.row_number().over(Window.partitionBy(F.lit(side)).orderBy(order, "label")))
    members = points.join(centers, "label").select(
        F.lit(side).alias("side"), "cluster_rank", "word", dot(F.col("v"), F.col("centroid")).alias("cos_to_centroid"), dot(F.col("v"), bu).alias("cos_to_beta"),
    )
    listed = members.groupBy("cluster_rank").agg(
        F.avg("cos_to_centroid").alias("coherence"), F.array_sort(F.collect_list(F.struct((-F.col("cos_to_centroid")).alias("c"), "word"))).alias("w"),
    )
    names = F.array_join(F.transform(F.slice("w", 1, top_words), lambda s: s["word"]), ", ")
    clusters = centers.join(listed, "cluster_rank").select(F.lit(side).alias("side"), "cluster_rank", "size", "centroid_cos_beta", "coherence", names.alias("top_words"))
    return clusters, members, centers.select("cluster_rank", "centroid")


def cluster_top_neighbors(kv: DataFrame, direction: Sequence[float], *, topn: int = 100, k: int | None = None, k_min: int = 2, k_max: int = 10, restrict_vocab: int = 50_000, random_state: int = 13, min_cluster_size: int = 2, side: str = "pos", top_words: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters, members and centroids of the words nearest to a pole (any side but 'pos' is the negative one)."""
    sign = 1.0 if side == "pos" else -1.0
    near = filtered_neighbors(kv, [sign * float(x) for x in direction], topn, restrict=restrict_vocab)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cos"), "rank"))
    words = near.withColumn("place", place).select("word", "place").join(kv.select("word", F.col("vec_unit").alias("v")), "word")
    points = cluster_labels(words, k=k, k_min=k_min, k_max=k_max, random_state=random_state).cache()
    return cluster_stats(points, direction, side=side, min_cluster_size=min_cluster_size, top_words=top_words)
