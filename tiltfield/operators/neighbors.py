"""Words nearest to a direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vecops import dot, literal, unit_list

#: A word with a digit, or that starts with a capital, is no neighbour.
BAD_WORD = r"(?U)\d|^[A-ZĄĆĘŁŃÓŚŹŻ]"


def filtered_neighbors(kv: DataFrame, direction: Sequence[float], topn: int = 20, cand: int = 2000, restrict: int = 10_000) -> DataFrame:
    """``word, rank, cos``: first ``cand`` by cosine among the ``restrict`` first words, then the good ones."""
    near = kv.where(F.col("rank") < restrict).select("word", "rank", dot(F.col("vec_unit"), literal(unit_list(direction))).alias("cos"))
    near = near.orderBy(F.desc("cos"), "rank").limit(cand)
    return near.where(~F.col("word").rlike(BAD_WORD)).orderBy(F.desc("cos"), "rank").limit(topn)


def nbrs(kv: DataFrame, direction: Sequence[float], sign: int = 1, n: int = 16, restrict_vocab: int = 10_000) -> DataFrame:
    """``word, cos, shift``: shift is the word's own vector along the pole."""
    pole = [float(x) if sign > 0 else -float(x) for x in direction]
    near = filtered_neighbors(kv, pole, n, restrict=restrict_vocab)
    return near.join(kv.select("word", "vec"), "word").select("word", "cos", dot(F.col("vec"), literal(pole)).alias("shift")).orderBy(F.desc("cos"), "word")


def top_words(kv: DataFrame, direction: Sequence[float], n: int = 10) -> DataFrame:
    """``side, rank, word, cos`` of both poles."""
    out = None
    for side, s in (("pos", 1.0), ("neg", -1.0)):
        near = filtered_neighbors(kv, [s * float(x) for x in direction], n)
        # at most n rows reach this window
        place = F.row_number().over(Window.partitionBy(F.lit(side)).orderBy(F.desc("cos"), "rank"))
        part = near.select(F.lit(side).alias("side"), place.alias("place"), "word", "cos").withColumnRenamed("place", "rank")
        out = part if out is None else out.unionByName(part)
    return out
