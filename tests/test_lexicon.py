"""Coverage, correlation and bins against numpy and pandas on small corpora."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tiltfield import coverage_by_lexicon, from_frame, from_pairs, suggest_lexicon, token_presence_stats
from tiltfield.operators.lexicon import quantile_bins


def frame(spark, texts, ys):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, ys))], "doc_id long, text string, y string")


def test_sources(spark):
    df = frame(spark, ["a b", None, "c"], ["1", "2", "x"])
    assert [(r["doc_id"], r["tokens"], r["y"]) for r in rows(from_frame(df, "text", "y"), "doc_id")] == [(0, ["a", "b"], 1.0), (1, [], 2.0)]
    assert [r["y"] for r in rows(from_pairs(df), "doc_id")] == [1.0, 2.0, None]
    with pytest.raises(ValueError):
        from_frame(df, "text", None)
    with pytest.raises(ValueError):
        from_frame(df, "text", "missing")


def test_bins_follow_pandas(spark):
    rng = np.random.default_rng(3)
    for ys in (rng.normal(size=37), rng.integers(0, 3, 40).astype(float), np.array([1.0] * 17 + [0.0] * 3)):
        df = frame(spark, ["a"] * len(ys), [repr(float(y)) for y in ys])
        got = [r["bin"] for r in rows(quantile_bins(from_frame(df, "text", "y")), "doc_id")]
        assert got == pd.qcut(ys, 4, labels=False, duplicates="drop").tolist()


def test_constant_outcome_has_no_bins(spark):
    df = from_frame(frame(spark, ["a b", "a", "b"], ["2", "2", "2"]), "text", "y")
    assert [r["bin"] for r in rows(quantile_bins(df), "doc_id")] == [None] * 3
    one = rows(token_presence_stats(df, "a"))[0]
    assert one["corr"] is None and one["rank"] == 0.0


def test_word_of_every_document_ranks_first(spark):
    df = from_frame(frame(spark, ["a b", "a c", "a b", "a c"], ["1", "2", "3", "4"]), "text", "y")
    first = suggest_lexicon(df, min_docs=1).first()
    assert (first.token, first.corr, first["rank"]) == ("a", 0.0, 1.0)


def test_no_word_is_frequent_enough(spark):
    df = from_frame(frame(spark, ["a", "b"], ["1", "2"]), "text", "y")
    out = suggest_lexicon(df)
    assert out.count() == 0 and out.columns == ["token", "docs", "cov_all", "cov_bal", "corr", "rank"]


def test_lexicon_word_without_documents(spark):
    df = from_frame(frame(spark, ["a b", "a", "c", "b"], ["1", "2", "3", "4"]), "text", "y")
    summary, per = coverage_by_lexicon(df, ["a", "zz"])
    assert summary.first().docs_any == 2
    assert [(r["word"], r["docs"], r["corr"]) for r in rows(per, "word")][1] == ("zz", 0, 0.0)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=4), st.integers(0, 6)), min_size=6, max_size=14))
def test_correlation_is_numpys(spark, docs):
    df = from_frame(frame(spark, [" ".join(t) for t, _ in docs], [str(y) for _, y in docs]), "text", "y")
    got = rows(token_presence_stats(df, "a"))[0]
    p, y = np.array([float("a" in t) for t, _ in docs]), np.array([float(y) for _, y in docs])
    assert got["docs"] == p.sum() and abs(got["cov_all"] - p.mean()) < 1e-12
    if p.std() == 0:
        assert got["corr"] == 0
    elif y.std() == 0:
        assert got["corr"] is None
    else:
        assert abs(got["corr"] - np.corrcoef(p, y)[0, 1]) < 1e-9
