"""Corpora with an outcome: doc_id, tokens, y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens


def _tokens(df: DataFrame, name: str) -> Column:
    """The column's declared type decides: strings are split at white space, arrays taken as they are."""
    kind = df.schema[name].dataType.typeName()
    if kind == "array":
        return F.transform(F.coalesce(F.col(name), F.expr("array()")), lambda t: t.cast("string"))
    return whitespace_tokens(F.coalesce(F.col(name).cast("string"), F.lit("")))


def outcome(column: Column) -> Column:
    """A number, null where there is none or it is not one."""
    y = column.try_cast("double")
    return F.when(~F.isnan(y), y)


def from_frame(df: DataFrame, text_col: str | None, score_col: str | None, id_col: str = "doc_id") -> DataFrame:
    """Rows whose outcome is missing are left out; a null text is an empty one."""
    if not text_col or not score_col:
        raise ValueError("text_col and score_col are needed")
    missing = [c for c in (text_col, score_col, id_col) if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.select(F.col(id_col).alias("doc_id"), _tokens(df, text_col).alias("tokens"), outcome(F.col(score_col)).alias("y")).where("y IS NOT NULL")


def from_pairs(df: DataFrame, text_col: str = "text", score_col: str = "y", id_col: str = "doc_id") -> DataFrame:
    """The same, but rows without an outcome stay, as a bin of their own."""
    return df.select(F.col(id_col).alias("doc_id"), _tokens(df, text_col).alias("tokens"), outcome(F.col(score_col)).alias("y"))
