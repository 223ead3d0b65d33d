"""Word vectors, stop words and corpora."""

from .corpus import from_frame, from_pairs
from .stopwords import load_stopwords
from .vectors import first_line_tokens, load_embeddings, normalize_kv, with_units

__all__ = ["first_line_tokens", "from_frame", "from_pairs", "load_embeddings", "load_stopwords", "normalize_kv", "with_units"]
