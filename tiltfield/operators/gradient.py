"""Standardize, principal components, least squares; back to a direction and its calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vecops import dot, literal, unit, unit_list


def f_survival(f: float, a: float, b: float) -> float:
    """P(F > f) for a and b degrees of freedom, by the incomplete beta's continued fraction."""
    if f <= 0:
        return 1.0
    return _beta_share(b / 2, a / 2, b / (b + a * f))


def _beta_share(p: float, q: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (p + 1) / (p + q + 2):
        return 1 - _beta_share(q, p, 1 - x)
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p
    c, d = 1.0, 1.0 / max(1e-300, 1 - (p + q) * x / (p + 1))
    total = d
    for m in range(1, 500):
        for step in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


@dataclass(frozen=True)
class Fit:
    """Numbers of a fitted direction; vectors are lists, as long as a word vector."""

    beta: list[float]
    beta_unit: list[float]
    n_kept: int
    n_components: int
    r2: float
    r2_adj: float
    f_stat: float
    f_pvalue: float
    beta_norm_stdCN: float
    y_mean: float
    y_std: float
    y_corr_pred: float
    delta_per_0p10_raw: float
    iqr_effect_raw: float
    x_mean: list[float]
    x_scale: list[float]
    components: list[list[float]]

    def summary(self, spark) -> DataFrame:
        """One row of the scalars."""
        names = ["n_kept", "n_components", "r2", "r2_adj", "f_stat", "f_pvalue", "beta_norm_stdCN", "y_mean", "y_std", "y_corr_pred", "delta_per_0p10_raw", "iqr_effect_raw"]
        kinds = ", ".join(f"{n} {'long' if n.startswith('n_') else 'double'}" for n in names)
        return spark.createDataFrame([tuple(None if isinstance(v := getattr(self, n), float) and math.isnan(v) else v for n in names)], kinds)


def l2_rows(vectors: DataFrame) -> DataFrame:
    """``vec`` divided by its length, at least TINY."""
    return vectors.withColumn("vec", unit(F.col("vec")))


def _moments(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred cross products of (vec, y): two narrow passes, d x d sums shuffled."""
    first = rows.select(Summarizer.metrics("mean", "count").summary(array_to_vector(F.concat("vec", F.array("y")))).alias("s")).first().s
    mean = first["mean"].toArray()

    def work(batches):
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                z = np.hstack([x, batch.column(1).to_numpy(zero_copy_only=False)[:, None]]) - mean
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    out = np.zeros((dim + 1) ** 2)
    for r in rows.select("vec", "y").mapInArrow(work, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return int(first["count"]), mean, out.reshape(dim + 1, dim + 1)


def fit_gradient(rows: DataFrame, n_components: int = 20, *, use_unit_beta: bool = True) -> Fit:
    """Fit ``rows(doc_id, vec, y)``; ``vec`` is used as it is, rows without y are left out.

    One pass gives the means, one the centred cross products, from which the components,
    the regression and the orientation follow; the last takes exact quartiles of the cosines.
    """
    rows = rows.where("y IS NOT NULL AND vec IS NOT NULL").select(F.col("vec").cast("array<double>").alias("vec"), "y")
    head = rows.select(F.size("vec").alias("d")).first()
    if head is None:
        raise ValueError("no document has a context of the lexicon: nothing to fit")
    dim = head.d
    n, mean, cross = _moments(rows, dim)
    if n_components > min(n, dim):
        raise ValueError(f"{n_components} components of {n} documents and {dim} dimensions")
    sd = np.sqrt(np.maximum(np.diag(cross) / n, 0))
    sd[sd < 1e-14] = 1.0  # a constant column has scale 1
    scaled = cross / np.outer(sd, sd)
    gram, xy, ss_tot = scaled[:dim, :dim], scaled[:dim, dim], float(scaled[dim, dim])
    value, vector = np.linalg.eigh(gram)
    order = np.argsort(-value)[:n_components]
    value, comp = value[order], vector[:, order].T
    if value.min() <= max(value.max(), 1e-300) * 1e-12:
        raise ValueError("a component has no variance: take fewer")
    w = comp @ xy / value
    ss_res = max(0.0, ss_tot - float((w * w * value).sum()))
    p = len(w)
    r2 = 1 - ss_res / ss_tot if ss_tot > 0 else 0.0
    free = n - p - 1
    mse = ss_res / free if free > 0 else math.inf
    f_stat = (ss_tot - ss_res) / max(p, 1) / mse if math.isfinite(mse) and mse > 0 else 0.0
    beta = comp.T @ w / sd[:dim]
    raw_xy, raw_xx = cross[:dim, dim] / sd[dim], cross[:dim, :dim]
    spread = math.sqrt(max(0.0, float(beta @ raw_xx @ beta)) * ss_tot)
    corr = float(beta @ raw_xy) / spread if spread > 0 else 0.0
    if corr < 0:
        beta, corr = -beta, -corr
    length = float(np.linalg.norm(beta))
    bu = unit_list(beta.tolist())
    q25, q75 = rows.select(F.percentile(dot(unit(F.col("vec")), literal(bu)), F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first().q
    y_std = float(sd[dim])
    return Fit(
        beta=beta.tolist(), beta_unit=bu if use_unit_beta else beta.tolist(), n_kept=n, n_components=p, r2=r2,
        r2_adj=1 - (1 - r2) * (n - 1) / free if free > 0 else math.nan, f_stat=f_stat,
        f_pvalue=f_survival(f_stat, p, free) if math.isfinite(mse) else math.nan, beta_norm_stdCN=length,
        y_mean=float(mean[dim]), y_std=y_std, y_corr_pred=corr, delta_per_0p10_raw=0.10 * length * y_std,
        iqr_effect_raw=(q75 - q25) * length * y_std, x_mean=mean[:dim].tolist(), x_scale=sd[:dim].tolist(), components=comp.tolist(),
    )


def doc_scores(vectors: DataFrame, beta: list[float], y_mean: float, y_std: float) -> DataFrame:
    """``doc_id, cos_align, score_std, yhat_raw`` of the kept documents.

    Scores use the vectors as they are, not centred, so they carry a constant.
    """
    bu = unit_list(beta)
    v = F.col("vec")
    rows = vectors.select("doc_id", dot(unit(v), literal(bu)).alias("cos_align"), dot(v, literal(beta)).alias("score_std"))
    return rows.withColumn("yhat_raw", F.lit(y_mean) + F.lit(y_std or 1.0) * F.col("score_std"))


def scores(docs: DataFrame, vectors: DataFrame, beta: list[float], y_mean: float, y_std: float, *, include_all: bool = True, include_true: bool = True) -> DataFrame:
    """``doc_id, kept, cos, yhat_std, yhat_raw[, y_true_std, y_true_raw]`` of ``docs(doc_id[, y])``.

    Documents without a vector have kept false and nulls, or no row unless ``include_all``.
    """
    found = doc_scores(vectors, beta, y_mean, y_std).select("doc_id", F.lit(True).alias("k"), "cos_align", "score_std", "yhat_raw")
    rows = docs.join(found, "doc_id", "left" if include_all else "inner")
    kept = F.coalesce("k", F.lit(False))
    out = [F.col("doc_id"), kept.alias("kept"), F.col("cos_align").alias("cos"), F.col("score_std").alias("yhat_std"), F.col("yhat_raw")]
    if include_true:
        y = F.when(kept, F.col("y"))
        out += [((y - F.lit(y_mean)) / F.lit(y_std or 1.0)).alias("y_true_std"), y.alias("y_true_raw")]
    return rows.select(*out)

