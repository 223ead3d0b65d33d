"""Exact URL membership by a cascade of Bloom filters.

Level 0 holds the listed keys; level 1 the keys of the universe (all the corpus's keys)
that level 0 takes in falsely; level 2 the listed keys that level 1 takes in falsely;
and so on until a level errs on none. A key of the universe is listed if the
first level that refuses it, or the number of levels, is odd.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MASK, get_blob, materialize, mix, put_blob, shared_dir

#: Share of false positives of level 0 and of the levels after it.
FIRST_RATE, NEXT_RATE = 0.01, 0.5
#: Bits of one file of a level.
SEGMENT = 1 << 23
#: Hosts whose pages make up the default list.
BLOCKED_HOSTS = r"(^|[.])([a-z0-9]+-)*(spam|casino|bets|ads|pills|adult|malware|phish)(-[a-z0-9-]*)?[.]"


def url_key(url: Column) -> Column:
    """Host and path: no scheme, www or m label, port, query, fragment or closing slash; lower-case host."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(.*)$", 1), r"/+$", "")
    return F.concat(host, path)


@dataclass(frozen=True)
class Level:
    folder: str
    bits: int
    hashes: int
    salt: int

    def test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which keys (two uint64 hashes each) the level takes in."""
        out = np.ones(len(a), dtype=bool)
        for pos in positions(a, b, self.bits, self.hashes, self.salt):
            segment, bit = pos // np.uint64(SEGMENT), pos % np.uint64(SEGMENT)
            for s in np.unique(segment[out]):
                at = np.flatnonzero(out & (segment == s))
                raw = get_blob(f"{self.folder}/{s}")
                byte = (bit[at] >> np.uint64(3)).astype(np.int64)
                out[at] = raw[byte] >> (bit[at] & np.uint64(7)).astype(np.uint8) & 1
        return out


    def column(self, a: Column, b: Column) -> Column:
        """Whether the level takes in a key, given as two longs."""

        @F.pandas_udf("boolean")
        def work(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(self.test(*(s.to_numpy().astype(np.int64).view(np.uint64) for s in (a, b))))

        return work(a, b)


def positions(a: np.ndarray, b: np.ndarray, bits: int, hashes: int, salt: int) -> list[np.ndarray]:
    """A level's places of keys; each level has its own, or keys that meet on one would meet on all."""
    a, step = mix(a + np.uint64(salt * 0x9E3779B97F4A7C15 & MASK)), mix(b ^ np.uint64(salt)) | np.uint64(1)
    return [(a + np.uint64(i) * step) % np.uint64(bits) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        for i, level in enumerate(self.levels):
            hit = level.test(a[live], b[live])
            out[live[~hit]] = i % 2 == 1
            live = live[hit]
        out[live] = len(self.levels) % 2 == 1
        return out

    def column(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        cascade = self

        @F.pandas_udf("boolean")
        def work(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(cascade.listed(*(s.to_numpy().astype(np.int64).view(np.uint64) for s in (a, b))))

        return key.isNotNull() & work(F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key))


def bloom(keys: DataFrame, n: int, rate: float, folder: str, salt: int = 0) -> Level:
    """A filter of the ``n`` keys in columns a and b (longs); one file for each run of SEGMENT bits."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    segment = SEGMENT

    @F.pandas_udf("array<long>")
    def at(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (s.to_numpy().astype(np.int64).view(np.uint64) for s in (a, b))
        return pd.Series(list(np.stack(positions(x, y, bits, hashes, salt), 1).astype(np.int64)))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["s"].iloc[0])
        raw = np.zeros(-(-min(segment, bits - s * segment) // 8), dtype=np.uint8)
        p = pdf["p"].to_numpy()
        p = p[p >= 0] % segment
        np.bitwise_or.at(raw, p >> 3, (1 << (p & 7)).astype(np.uint8))
        put_blob(f"{folder}/{s}", raw.tobytes())
        return pd.DataFrame({"s": [s]})

    set_ = keys.select(F.explode(at("a", "b")).alias("p")).withColumn("s", F.floor(F.col("p") / segment))
    # segments without bits are read too
    every = keys.sparkSession.range(-(-bits // segment)).select(F.lit(-1).cast("long").alias("p"), F.col("id").alias("s"))
    set_.unionByName(every).groupBy("s").applyInPandas(write, "s long").agg(F.count("*")).collect()
    return Level(folder, bits, hashes, salt)


def build(listed: DataFrame, universe: DataFrame, first_rate: float = FIRST_RATE, next_rate: float = NEXT_RATE) -> Cascade:
    """The cascade of the keys in ``listed`` (column ``key``) over those in ``universe``.

    Null keys are left out, repeated ones count once; a listed key outside the universe
    is added to it. An empty list gives a cascade without levels, which lists nothing.
    """
    spark = universe.sparkSession
    folder = shared_dir(spark)
    both = universe.select("key", F.lit(False).alias("l")).unionByName(listed.select("key", F.lit(True).alias("l"))).where("key is not null")
    hashed = both.select(F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b"), "l")
    keys = materialize(hashed.groupBy("a", "b").agg(F.max("l").alias("l")), folder, "keys")
    inside, outside = keys.where("l"), keys.where("not l")
    levels: list[Level] = []
    while n := inside.count():
        levels.append(bloom(inside, n, next_rate if levels else first_rate, f"{folder}/level{len(levels)}", len(levels)))
        wrong = materialize(outside.where(levels[-1].column(F.col("a"), F.col("b"))), folder, f"wrong{len(levels)}")
        inside, outside = wrong, inside
    return Cascade(tuple(levels))


def default_list(pages: DataFrame) -> DataFrame:
    """Keys of the pages on hosts that BLOCKED_HOSTS matches."""
    key = url_key(F.col("url"))
    return pages.select(key.alias("key")).where(F.regexp_extract("key", r"^([^/]*)", 1).rlike(BLOCKED_HOSTS)).distinct()


def filter_urls(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``page_id, url_key, listed`` for each row of ``pages``; the universe is their keys.

    A null URL has a null key and isn't listed; an empty one has the empty key.
    Null ids, repeated rows and other columns are left as they are; an empty table gives
    an empty result. The test is a narrow pass over memory-mapped filters, without a join.
    """
    keyed = pages.select("page_id", url_key(F.col("url")).alias("url_key"))
    universe = keyed.select(F.col("url_key").alias("key"))
    cascade = build(default_list(pages) if listed is None else listed, universe)
    return keyed.withColumn("listed", cascade.column(F.col("url_key")))


ORACLE = f"""
with b as (
  select page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') bare from pages),
h as (
  select page_id, bare, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/]*)', 1)), ':[0-9]*$', ''), '^(www|m)[.]', '') host from b),
k as (select page_id, host, host || regexp_replace(regexp_extract(bare, '^[^/]*(.*)$', 1), '/+$', '') url_key from h),
l as (select distinct url_key from k where regexp_matches(host, '{BLOCKED_HOSTS}'))
select page_id, url_key, coalesce(url_key in (select url_key from l where url_key is not null), false) listed from k"""
