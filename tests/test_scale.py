"""What keeps the shuffles of contexts and passages in proportion to the texts."""

import numpy as np
from conftest import rows
from test_model import TEXTS, docs, vectors

from tiltfield import build_doc_vectors, preprocess_texts
from tiltfield.operators import context, passages


def test_vectors_do_not_follow_pairs(spark):
    kv, _ = vectors(spark)
    plan = build_doc_vectors(docs(spark, TEXTS), kv, {"sun", "rain"})._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate_metrics" not in plan


def test_cosines_are_those_of_the_vectors(spark):
    kv, _ = vectors(spark)
    along = np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))[0][:2]
    vec = {(r["doc_id"], r["i"]): np.array(r["v"]) for r in rows(context.occurrence_vectors(docs(spark, TEXTS), kv, ["sun"], unit=True))}
    cos = {(r["doc_id"], r["i"]): r["v"] for r in rows(context.occurrence_cosines(docs(spark, TEXTS), kv, ["sun"], along.tolist()))}
    assert cos.keys() == vec.keys() and len(cos) > 3
    for k, v in vec.items():
        assert np.allclose(cos[k], along @ v / np.linalg.norm(v), atol=1e-12)


def test_packed_passages_are_the_joined_ones(spark):
    pre = preprocess_texts(spark.createDataFrame([(0, "Rain. Hot sun. Cold wind blew. Dry."), (1, "Sun hot dry calm storm wind. Rain."), (2, None)], "doc_id long, text string"))
    kv, _ = vectors(spark)
    packed, joined = (passages.snippets_along_beta(pre, kv, [1.0, 0, 0, 0, 0], ["sun", "rain"], top_per_side=n).collect() for n in (None, 200))
    assert packed == joined and len(packed) > 4
