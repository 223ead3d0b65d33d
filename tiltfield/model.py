"""The fitted analysis: one object over lazy frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import context, gradient, neighbors, passages, themes
from .sources import load_embeddings


class ConceptGradient:
    """Fit a direction of meaning that goes with an outcome, and read it.

    ``docs(doc_id, tokens, y)``; ``kv`` a word vector table or a path to one; ``lexicon`` the
    seed words. Documents without a seed context or an outcome are left out of the fit.
    ``counts`` are those of compute_global_sif over ``docs``, if they are there already.
    """

    def __init__(self, kv, docs: DataFrame, lexicon: Iterable[str], *, l2_normalize_docs: bool = True, use_unit_beta: bool = True, n_pca: int = 20, window: int = 3, sif_a: float = 1e-3, counts: tuple[DataFrame, DataFrame] | None = None) -> None:
        self.kv = load_embeddings(docs.sparkSession, kv) if isinstance(kv, str) else kv
        self.docs, self.lexicon, self.window, self.sif_a = docs, sorted(set(lexicon)), window, sif_a
        vectors = context.build_doc_vectors(docs.select("doc_id", "tokens"), self.kv, self.lexicon, window=window, sif_a=sif_a, counts=counts)
        if l2_normalize_docs:
            vectors = gradient.l2_rows(vectors)
        self.vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept = self.vectors.join(docs.select("doc_id", "y"), "doc_id").where("y IS NOT NULL")
        self.fit = gradient.fit_gradient(self.kept, n_pca, use_unit_beta=use_unit_beta)
        self.centroids: dict[str, DataFrame] = {}

    def __getattr__(self, name: str):
        if name == "fit" or name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.fit, name)

    @property
    def n_raw(self) -> int:
        return self.docs.count()

    @property
    def n_dropped(self) -> int:
        return self.n_raw - self.fit.n_kept

    def keep_mask(self) -> DataFrame:
        return context.kept_mask(self.docs, self.kept)

    def summary(self) -> DataFrame:
        """One row of model and calibration statistics."""
        n = self.docs.agg(F.count("*").alias("n_raw"))
        return n.crossJoin(self.fit.summary(self.docs.sparkSession)).withColumn("n_dropped", F.col("n_raw") - F.col("n_kept"))

    print_model_stats = lambda self: self.summary().show(truncate=False, vertical=True)

    def nbrs(self, sign: int = 1, n: int = 16, restrict_vocab: int = 10_000) -> DataFrame:
        return neighbors.nbrs(self.kv, self.fit.beta_unit, sign, n, restrict_vocab)

    def top_words(self, n: int = 10) -> DataFrame:
        return neighbors.top_words(self.kv, self.fit.beta_unit, n)

    def doc_scores(self) -> DataFrame:
        return gradient.doc_scores(self.kept, self.fit.beta, self.fit.y_mean, self.fit.y_std)

    def scores(self, include_all: bool = True, include_true: bool = True) -> DataFrame:
        return gradient.scores(self.docs.select("doc_id", "y"), self.kept, self.fit.beta, self.fit.y_mean, self.fit.y_std, include_all=include_all, include_true=include_true)

    def cluster_neighbors_sign(self, *, side: str = "pos", **options) -> tuple[DataFrame, DataFrame]:
        """Clusters and members of a pole's neighbours; see themes.cluster_top_neighbors."""
        clusters, members, self.centroids[side] = themes.cluster_top_neighbors(self.kv, self.fit.beta_unit, side=side, **options)
        return clusters, members

    def cluster_neighbors(self, **options) -> tuple[DataFrame, DataFrame]:
        (a, b), (c, d) = (self.cluster_neighbors_sign(side=s, **options) for s in ("pos", "neg"))
        return a.unionByName(c), b.unionByName(d)

    def cluster_snippets(self, pre_docs: DataFrame, *, side: str = "both", seeds: Iterable[str] | None = None, top_per_cluster: int = 100) -> dict[str, DataFrame]:
        """Snippets by cluster of the sides that were clustered before."""
        wanted = ["pos", "neg"] if side == "both" else [side]
        if any(s not in self.centroids for s in wanted):
            raise RuntimeError("cluster the neighbours first")
        return {s: passages.cluster_snippets_by_centroids(pre_docs, self.kv, self.centroids[s], seeds or self.lexicon, side=s, token_window=self.window, sif_a=self.sif_a, top_per_cluster=top_per_cluster) for s in wanted}

    def beta_snippets(self, pre_docs: DataFrame, *, seeds: Iterable[str] | None = None, top_per_side: int | None = 200, min_cosine: float | None = None) -> DataFrame:
        return passages.snippets_along_beta(pre_docs, self.kv, self.fit.beta, seeds or self.lexicon, token_window=self.window, sif_a=self.sif_a, top_per_side=top_per_side, min_cosine=min_cosine)
