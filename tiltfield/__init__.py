"""Concept gradients over text, as Spark plans."""

from .model import ConceptGradient
from .operators.context import build_doc_vectors, compute_global_sif
from .operators.lexicon import coverage_by_lexicon, suggest_lexicon, token_presence_stats
from .operators.neighbors import filtered_neighbors
from .operators.preprocess import build_docs_from_preprocessed, load_analyzer, preprocess_texts
from .operators.themes import cluster_top_neighbors
from .sources import from_frame, from_pairs, load_embeddings, load_stopwords, normalize_kv

__all__ = [
    "ConceptGradient", "build_docs_from_preprocessed", "build_doc_vectors", "cluster_top_neighbors", "compute_global_sif", "coverage_by_lexicon", "filtered_neighbors",
    "from_frame", "from_pairs", "load_analyzer", "load_embeddings", "load_stopwords", "normalize_kv", "preprocess_texts", "suggest_lexicon", "token_presence_stats",
]
