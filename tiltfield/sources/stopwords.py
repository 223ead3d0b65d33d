"""Stop words: Spark's own lists, or a file of one word a line for other languages."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_NAMES = {"da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish"}


def load_stopwords(lang: str, *, spark: SparkSession | None = None, path: str | None = None, lowercase: bool = True) -> list[str]:
    """Sorted stop words of a language code or name; ``path`` names a file instead.

    An unknown language without a file is a LookupError, a file without words a ValueError.
    """
    if path is not None:
        spark = spark or SparkSession.getActiveSession()
        rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> ''").collect()
        if not rows:
            raise ValueError(f"no stop words in {path}")
        found = [r.w for r in rows]
    else:
        name = _NAMES.get(lang.lower(), lang.lower())
        if name not in _NAMES.values():
            raise LookupError(f"no stop words for {lang!r}; give a file")
        found = StopWordsRemover.loadDefaultStopWords(name)
    return sorted({w.lower() if lowercase else w for w in found})
