"""Which words make a good lexicon: coverage over the outcome's range, correlation with it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_BINS, CORR_CAP, MIN_DOCS, TOP_K = 4, 0.30, 5, 150


def outcome_stats(corpus: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """One row: documents, mean and population sd of y, missing ys, the bins' distinct edges."""
    probs = ", ".join(f"{i / n_bins!r}D" for i in range(n_bins + 1))
    return corpus.agg(
        F.count("*").alias("docs_all"), F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_sd"), F.count_if(F.col("y").isNull()).alias("y_null"),
        F.array_distinct(F.expr(f"percentile(y, array({probs}))")).alias("edges"),
    )


def bin_of(y: Column, edges: Column) -> Column:
    """Number of the quantile bin (right edges belong to it); null without y or with a single edge."""
    return F.when((F.size(edges) > 1) & y.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < y)) - 1, F.lit(0)))


def quantile_bins(corpus: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """``doc_id, bin`` of ``corpus(doc_id, y)``."""
    return corpus.select("doc_id", "y").crossJoin(outcome_stats(corpus, n_bins).select("edges")).select("doc_id", bin_of(F.col("y"), F.col("edges")).alias("bin"))


def _binned(corpus: DataFrame, n_bins: int) -> DataFrame:
    """corpus with its bin (b) and its distance from the mean outcome (dy)."""
    stats = outcome_stats(corpus, n_bins).select("edges", F.col("y_mean").alias("m"))
    return corpus.crossJoin(stats).select("doc_id", "tokens", "y", bin_of(F.col("y"), F.col("edges")).alias("b"), (F.col("y") - F.col("m")).alias("dy"))


def _totals(corpus: DataFrame, n_bins: int) -> DataFrame:
    """One row: outcome_stats and the size of each bin (n0, n1, ...)."""
    sizes = _binned(corpus, n_bins).agg(*[F.count_if(F.col("b") == i).alias(f"n{i}") for i in range(n_bins)], F.count_if(F.col("b").isNull()).alias("n_null"))
    return outcome_stats(corpus, n_bins).crossJoin(sizes)


def _sums(n_bins: int) -> list[Column]:
    return [F.count("*").alias("docs"), F.sum("dy").alias("s"), *[F.count_if(F.col("b") == i).alias(f"k{i}") for i in range(n_bins)]]


def _measures(n_bins: int, corr_cap: float | None = None) -> dict[str, Column]:
    """Columns over a row with docs, s, k0.. and the totals.

    Presence is 0 or 1, so its moments follow from the count of documents and the sum of
    their outcomes. A bin of missing outcomes adds a coverage of 0 to the mean of all.
    """
    n, docs = F.col("docs_all"), F.col("docs")
    p = docs / n
    cov = [F.col(f"k{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)) for i in range(n_bins)]
    some = [F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in range(n_bins)]
    empty = F.when(F.col("n_null") > 0, 1).otherwise(0)
    corr = F.when(p >= 1, 0.0).when(docs == 0, 0.0).when((F.col("y_null") > 0) | (F.col("y_sd") <= 0), None).otherwise(F.col("s") / n / (F.sqrt(p * (1 - p)) * F.col("y_sd")))
    bins = sum(some[1:], some[0]) + empty
    balanced = sum((F.coalesce(c, F.lit(0.0)) for c in cov[1:]), F.coalesce(cov[0], F.lit(0.0))) / F.greatest(bins, F.lit(1))
    last = F.coalesce(*[F.when(F.col(f"n{i}") > 0, cov[i]) for i in reversed(range(n_bins))])
    first = F.coalesce(*[F.when(F.col(f"n{i}") > 0, cov[i]) for i in range(n_bins)])
    edge = lambda c: F.when(F.col("n_null") > 0, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    out = {"cov_all": F.coalesce(F.try_divide(docs, n), F.lit(0.0)), "cov_bal": balanced, "corr": corr, "q1": edge(first), "q4": edge(last)}
    if corr_cap is not None:  # without a correlation the penalty is full
        out["rank"] = balanced * (1 - F.least(F.lit(1.0), F.coalesce(F.abs(corr) / corr_cap, F.lit(1.0))))
    return out


def document_frequency(corpus: DataFrame) -> DataFrame:
    """``token, docs``: in how many documents each token is."""
    each = corpus.select(F.explode_outer(F.array_distinct("tokens")).alias("token")).where("token IS NOT NULL")
    return each.groupBy("token").agg(F.count("*").alias("docs"))


def suggest_lexicon(corpus: DataFrame, *, top_k: int = TOP_K, min_docs: int = MIN_DOCS, n_bins: int = N_BINS, corr_cap: float = CORR_CAP) -> DataFrame:
    """``token, docs, cov_all, cov_bal, corr, rank`` of ``corpus(doc_id, tokens, y)``, best first.

    One shuffle by token over partial sums, whatever the vocabulary; ties go by token.
    """
    each = _binned(corpus, n_bins).select(F.explode_outer(F.array_distinct("tokens")).alias("token"), "b", "dy").where("token IS NOT NULL")
    per = each.groupBy("token").agg(*_sums(n_bins)).where(F.col("docs") >= min_docs)
    m = _measures(n_bins, corr_cap)
    rows = per.crossJoin(_totals(corpus, n_bins)).select("token", "docs", *[m[c].alias(c) for c in ("cov_all", "cov_bal", "corr", "rank")])
    return rows.orderBy(F.desc("rank"), F.desc("cov_bal"), F.desc("docs"), "token").limit(top_k)


def token_presence_stats(corpus: DataFrame, token: str, *, n_bins: int = N_BINS, corr_cap: float = CORR_CAP) -> DataFrame:
    """One row ``token, docs, cov_all, cov_bal, corr, rank, q1, q4``."""
    per = _binned(corpus, n_bins).where(F.array_contains("tokens", token)).agg(*_sums(n_bins))
    m = _measures(n_bins, corr_cap)
    return per.crossJoin(_totals(corpus, n_bins)).select(F.lit(token).alias("token"), "docs", *[m[c].alias(c) for c in ("cov_all", "cov_bal", "corr", "rank", "q1", "q4")])


def coverage_by_lexicon(corpus: DataFrame, lexicon: Iterable[str], *, n_bins: int = N_BINS) -> tuple[DataFrame, DataFrame]:
    """Summary row ``docs_any, cov_all, q1, q4, corr_any``; ``word, docs, cov_all, q1, q4, corr`` a word.

    Words that no document has are there with zeros.
    """
    words = list(dict.fromkeys(str(w) for w in lexicon))
    spark = corpus.sparkSession
    m, totals = _measures(n_bins), _totals(corpus, n_bins)
    hit = F.filter(F.array_distinct("tokens"), lambda t: t.isin(words))
    hits = _binned(corpus, n_bins).select(hit.alias("hits"), "b", "dy")
    summary = hits.where(F.size("hits") > 0).agg(*_sums(n_bins)).crossJoin(totals)
    summary = summary.select(F.col("docs").alias("docs_any"), m["cov_all"].alias("cov_all"), m["q1"].alias("q1"), m["q4"].alias("q4"), m["corr"].alias("corr_any"))
    per = hits.select(F.explode_outer("hits").alias("word"), "b", "dy").where("word IS NOT NULL").groupBy("word").agg(*_sums(n_bins))
    table = spark.createDataFrame([(w,) for w in words], "word string").join(per, "word", "left").na.fill(0)
    rows = table.crossJoin(totals).select("word", "docs", m["cov_all"].alias("cov_all"), m["q1"].alias("q1"), m["q4"].alias("q4"), m["corr"].alias("corr"))
    return summary, rows.orderBy(F.desc("cov_all"), F.desc("docs"), "word")
