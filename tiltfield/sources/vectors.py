"""Word vector tables: word, rank (0 first), vec (array<float>), vec_unit (array<double>)."""

from __future__ import annotations

import gzip
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vecops import unit

_SCHEMA = "word string, pos long, vec array<float>"


def with_units(kv: DataFrame) -> DataFrame:
    """Adds unit vectors to (word, rank, vec)."""
    return kv.select("word", F.col("rank").cast("int").alias("rank"), F.col("vec").cast("array<float>").alias("vec"), unit(F.col("vec")).alias("vec_unit"))


def first_line_tokens(spark: SparkSession, path: str) -> list[str]:
    """White-space tokens of a file's first line; gzip is seen by its name."""
    row = spark.read.text(path).first()
    return row.value.split() if row else []


def _ranked(raw: DataFrame) -> DataFrame:
    """Of repeated words the first stays; ranks follow the file, without gaps.

    Positions grow along the file. Ranks are a running count in two steps: rows before each
    partition's range, then inside it, so no single task orders the whole table.
    """
    first = raw.groupBy("word").agg(F.min_by("vec", "pos").alias("vec"), F.min("pos").alias("pos"))
    cell = F.shiftright("pos", 16)
    first = first.withColumn("cell", cell)
    sizes = first.groupBy("cell").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("cell", "before")
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("pos"))
    return with_units(first.withColumn("r", inside).join(before, "cell").select("word", (F.col("before") + F.col("r") - 1).alias("rank"), "vec"))


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    head = first_line_tokens(spark, path)
    header = len(head) == 2 and all(t.isdigit() for t in head)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    if header:
        lines = lines.where("pos > 0")
    parts = F.filter(F.split("value", "[ \t]+"), lambda x: x != "")
    rows = lines.select("pos", parts.alias("p")).where("size(p) > 1")
    return _ranked(rows.select(F.col("p")[0].alias("word"), "pos", F.transform(F.slice("p", 2, 1_000_000), lambda x: x.cast("float")).alias("vec")))


def parse_binary(raw: bytes):
    """(words, matrix) of the binary format: header 'V D', then word, space, D floats."""
    end = raw.index(b"\n")
    n, dim = (int(x) for x in raw[:end].split())
    at, words, out = end + 1, [], np.empty((n, dim), np.float32)
    for i in range(n):
        space = raw.index(b" ", at)
        words.append(raw[at:space].lstrip(b"\n").decode("utf-8", "ignore"))
        out[i] = np.frombuffer(raw, "<f4", dim, space + 1)
        at = space + 1 + 4 * dim
    return words, out


def _read_binary(spark: SparkSession, path: str) -> DataFrame:
    def work(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, m = parse_binary(gzip.decompress(raw) if name.lower().endswith(".gz") else raw)
                for i in range(0, len(words), 20_000):
                    part = m[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000]), pa.array(np.arange(i, i + len(part))), pa.array(list(part), pa.list_(pa.float32()))], names=["word", "pos", "vec"])

    return _ranked(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, _SCHEMA))


def load_embeddings(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Word vectors by the file's extension (or ``format``): text, binary or parquet.

    ``.bin`` is the binary format, ``.txt`` and ``.vec`` text with or without a header, both
    also gzipped; ``.parquet`` has (word, rank, vec). Pickled native files can't be read.
    """
    low = path.lower()
    bare = low[:-3] if low.endswith(".gz") else low
    kind = format or {".bin": "binary", ".txt": "text", ".vec": "text", ".parquet": "parquet"}.get(os.path.splitext(bare.rstrip("/"))[1])
    if kind == "text":
        return _read_text(spark, path)
    if kind == "binary":
        return _read_binary(spark, path)
    if kind == "parquet":
        return with_units(spark.read.parquet(path))
    raise ValueError(f"{path}: pickled vectors aren't read; convert to text, binary or parquet (word, rank, vec)")


def _without(mean: np.ndarray, top: np.ndarray):
    """Arrow batches as one matrix: centred rows less their parts along the directions."""

    @F.pandas_udf("array<double>")
    def work(v: pd.Series) -> pd.Series:
        if not len(v):
            return v
        x = np.stack(v.to_numpy()) - mean
        return pd.Series(list(x - (x @ top.T) @ top), index=v.index)

    return work


def normalize_kv(kv: DataFrame, *, l2: bool = True, abtt_m: int = 0, re_normalize: bool = True) -> DataFrame:
    """Unit rows, then without their ``abtt_m`` greatest common directions, then unit again.

    Rows are centred only if directions are removed. Words and ranks stay.
    """
    v = unit(F.col("vec")) if l2 else F.col("vec").cast("array<double>")
    rows = kv.select("word", "rank", v.alias("v"))
    if abtt_m > 0:
        ml = rows.select(array_to_vector("v").alias("x"))
        mean = ml.select(Summarizer.mean(F.col("x")).alias("m")).first().m.toArray().tolist()
        m = min(abtt_m, len(mean), kv.count())
        top = PCA(k=m, inputCol="x", outputCol="z").fit(ml).pc.toArray().T
        rows = rows.withColumn("v", _without(np.array(mean), top)(F.col("v")))
    if re_normalize:
        rows = rows.withColumn("v", unit(F.col("v")))
    return with_units(rows.select("word", "rank", F.col("v").cast("array<float>").alias("vec")))
