"""The fit against numpy; vectors, clusters and snippets on small hand-made corpora."""

import math

import numpy as np
import pytest
from conftest import rows

from tiltfield import ConceptGradient, build_doc_vectors, preprocess_texts
from tiltfield.operators import context, gradient, passages, themes
from tiltfield.sources import with_units

WORDS = ["sun", "rain", "wind", "snow", "hot", "cold", "calm", "storm", "dry"]


def vectors(spark, dim=5, seed=0, words=WORDS):
    v = np.random.default_rng(seed).normal(size=(len(words), dim)).astype(np.float32)
    return with_units(spark.createDataFrame([(w, i, x.tolist()) for i, (w, x) in enumerate(zip(words, v))], "word string, rank int, vec array<float>")), dict(zip(words, v.astype(float)))


def docs(spark, texts, ys=None):
    return spark.createDataFrame([(i, t.split(), None if ys is None else ys[i]) for i, t in enumerate(texts)], "doc_id long, tokens array<string>, y double")


def brute(texts, table, seeds, window=3, a=1e-3):
    tokens = [t.split() for t in texts]
    flat = [w for t in tokens for w in t]
    out = {}
    for d, t in enumerate(tokens):
        occ = []
        for i, w in enumerate(t):
            if w not in seeds:
                continue
            near = [(table[c], a / (a + flat.count(c) / len(flat))) for j, c in enumerate(t) if j != i and abs(i - j) <= window and c in table]
            if near:
                occ.append(sum(v * k for v, k in near) / sum(k for _, k in near))
        if occ:
            out[d] = np.mean(occ, 0)
    return out


TEXTS = ["sun hot sun dry", "rain", "x y z", "sun sun", "q w sun e r t hot", "rain cold storm sun", "wind", "sun"]


def test_doc_vectors(spark):
    kv, table = vectors(spark)
    got = {r["doc_id"]: r["vec"] for r in rows(build_doc_vectors(docs(spark, TEXTS), kv, {"sun", "rain"}))}
    want = brute(TEXTS, table, {"sun", "rain"})
    assert got.keys() == want.keys()  # lone seeds and texts without seeds are dropped
    for d, v in want.items():
        assert np.allclose(got[d], v, atol=1e-12)
    mask = {r["doc_id"]: r["kept"] for r in rows(context.kept_mask(docs(spark, TEXTS), build_doc_vectors(docs(spark, TEXTS), kv, ["sun", "rain"])))}
    assert mask == {d: d in want for d in range(len(TEXTS))}


def test_many_seeds_are_joined(spark):
    seeds = ["sun", *(f"w{i}" for i in range(1500))]
    got = rows(context.seed_occurrences(docs(spark, TEXTS), seeds).select("doc_id", "i"), "doc_id", "i")
    assert got == rows(context.seed_occurrences(docs(spark, TEXTS), ["sun"]).select("doc_id", "i"), "doc_id", "i")


def reference_fit(x, y, k):
    xs = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    ys = (y - y.mean()) / y.std()
    c = np.linalg.svd(xs - xs.mean(0), full_matrices=False)[2][:k]
    z = xs @ c.T
    w = np.linalg.solve(z.T @ z, z.T @ ys)
    beta = c.T @ w / np.where(x.std(0) > 0, x.std(0), 1)
    if np.corrcoef(ys, x @ beta)[0, 1] < 0:
        beta = -beta
    return beta, 1 - ((ys - z @ w) ** 2).sum() / (ys**2).sum()


def test_fit_is_numpys(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)) + 3
    y = x @ rng.normal(size=6) + rng.normal(size=60)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "doc_id long, vec array<double>, y double")
    fit = gradient.fit_gradient(df, 4)
    beta, r2 = reference_fit(x, y, 4)
    assert np.allclose(fit.beta, beta, atol=1e-10) and abs(fit.r2 - r2) < 1e-12
    cos = x @ beta / np.linalg.norm(x, axis=1) / np.linalg.norm(beta)
    iqr = np.subtract(*np.percentile(cos, [75, 25])) * np.linalg.norm(beta) * y.std()
    assert abs(fit.iqr_effect_raw - iqr) < 1e-9 and abs(fit.y_corr_pred - np.corrcoef(y, x @ beta)[0, 1]) < 1e-9
    assert 0 <= fit.f_pvalue <= 1
    with pytest.raises(ValueError):
        gradient.fit_gradient(df, 7)
    with pytest.raises(ValueError):
        gradient.fit_gradient(df.where("false"), 1)


def test_f_distribution():
    # P(F > f) with 2 and m degrees of freedom is (1 + 2 f / m) ** (-m / 2)
    for m in (4, 10, 57):
        for f in (0.1, 1.0, 3.7, 40.0):
            assert abs(gradient.f_survival(f, 2, m) - (1 + 2 * f / m) ** (-m / 2)) < 1e-12


def test_small_sample_branch_and_scores(spark):
    kv, _ = vectors(spark)
    model = ConceptGradient(kv, docs(spark, ["sun hot", "sun cold", "rain dry", "rain storm", "nothing"], [1.0, 1.2, 1.1, 0.8, 3.0]), {"sun", "rain"}, n_pca=3)
    assert math.isnan(model.r2_adj) and model.f_stat == 0 and math.isnan(model.f_pvalue)
    every = rows(model.scores(), "doc_id")
    assert [r["kept"] for r in every] == [True] * 4 + [False] and every[4]["cos"] is None
    assert model.scores(include_all=False).count() == 4 and model.n_dropped == 1
    assert model.summary().first().n_raw == 5
    assert model.top_words(3).groupBy("side").count().count() == 2


def test_clusters_and_silhouette(spark):
    rng = np.random.default_rng(2)
    centers = np.eye(4)[:3]
    x = np.vstack([c + 0.05 * rng.normal(size=(8, 4)) for c in centers])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    words = "abcdefghijklmnopqrstuvwx"
    kv = with_units(spark.createDataFrame([(w, i, v.tolist()) for i, (w, v) in enumerate(zip(words, x))], "word string, rank int, vec array<float>"))
    clusters, members, centroids = themes.cluster_top_neighbors(kv, [1.0, 0.5, 0.2, 0.0], topn=24)
    found = rows(clusters, "cluster_rank")
    assert [c["size"] for c in found] == [8, 8, 8] and all(-1 <= c["coherence"] <= 1 + 1e-9 for c in found)
    assert [c["centroid_cos_beta"] for c in found] == sorted((c["centroid_cos_beta"] for c in found), reverse=True)
    assert members.count() == 24 and centroids.count() == 3
    with pytest.raises(Exception, match="too few"):
        themes.cluster_top_neighbors(kv, [1.0, 0.5, 0.2, 0.0], topn=1)[0].collect()


def test_snippets_cross_sentences(spark):
    raw = spark.createDataFrame([(0, "Rain. Hot sun. Cold wind blew. Dry."), (1, "Sun hot dry calm storm wind. Rain."), (2, None)], "doc_id long, text string")
    pre = preprocess_texts(raw)
    kv, _ = vectors(spark)
    got = rows(passages.snippets_along_beta(pre, kv, [1.0, 0, 0, 0, 0], ["sun"]).where("side_label = 'beta_pos'"), "doc_id")
    # the window of the first document reaches back and ahead: back wins
    assert got[0]["snippet_anchor"] == "Rain. Hot sun." and (got[0]["start_sent_idx"], got[0]["end_sent_idx"]) == (0, 1)
    assert got[1]["snippet_anchor"] == "Sun hot dry calm storm wind." and got[1]["start_token_idx"] == 0
    none = passages.snippets_along_beta(pre, kv, [1.0, 0, 0, 0, 0], ["nowhere"])
    assert none.count() == 0 and none.columns[0] == "side_label"


def test_cluster_snippets_need_clusters(spark):
    kv, _ = vectors(spark)
    model = ConceptGradient(kv, docs(spark, ["sun hot", "sun cold", "rain dry", "rain storm"], [1.0, 1.2, 1.1, 0.8]), {"sun", "rain"}, n_pca=2)
    with pytest.raises(RuntimeError):
        model.cluster_snippets(None)


def test_snippets_come_best_first(spark):
    texts = ["sun hot.", "sun cold storm.", "rain dry wind sun.", "calm sun storm.", "hot dry sun. cold sun."]
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kv, _ = vectors(spark)
    found = [r.asDict() for r in passages.snippets_along_beta(preprocess_texts(raw), kv, [1.0, -0.5, 0.2, 0, 0.3], ["sun"]).collect()]
    assert [r["side_label"] for r in found] == ["beta_pos"] * 6 + ["beta_neg"] * 6
    for side in (found[:6], found[6:]):
        assert [r["cosine"] for r in side] == sorted((r["cosine"] for r in side), reverse=True)
    every = [r.asDict() for r in passages.snippets_along_beta(preprocess_texts(raw), kv, [1.0, -0.5, 0.2, 0, 0.3], ["sun"], top_per_side=None).collect()]
    name = lambda found: [(r["side_label"], r["doc_id"], r["start_token_idx"], round(r["cosine"], 9)) for r in found]
    assert name(every) == name(found)
    few = [r.asDict() for r in passages.snippets_along_beta(preprocess_texts(raw), kv, [1.0, -0.5, 0.2, 0, 0.3], ["sun"], top_per_side=2).collect()]
    assert name(few) == name(found[:2] + found[6:8])


def test_model_wrappers(spark):
    kv, _ = vectors(spark)
    texts = ["sun hot", "sun cold", "rain dry", "rain storm", "sun calm wind", "rain hot wind"]
    y = [1.0, 1.2, 1.1, 0.8, 0.3, 2.0]
    model = ConceptGradient(kv, docs(spark, texts, y), {"sun", "rain"}, n_pca=2)
    pre = preprocess_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    along = [r.asDict() for r in model.beta_snippets(pre, top_per_side=3).collect()]
    assert [r["side_label"] for r in along] == ["beta_pos"] * 3 + ["beta_neg"] * 3
    clusters, _ = model.cluster_neighbors(topn=5, k=2, min_cluster_size=1)
    assert {r["side"] for r in clusters.collect()} == {"pos", "neg"}
    by = model.cluster_snippets(pre)
    assert set(by) == {"pos", "neg"}
    for side, frame in by.items():
        got = [(r["centroid_label"], r["cosine"]) for r in frame.collect()]
        assert got and got == sorted(got, key=lambda r: (r[0], -r[1])) and all(r[0].startswith(f"{side}_cluster_") for r in got)
    assert model.scores().count() == 6 and model.n_dropped == 0


def test_unit_beta_is_the_same_direction(spark):
    kv, _ = vectors(spark)
    d = docs(spark, ["sun hot", "sun cold", "rain dry", "rain storm", "sun calm wind", "rain hot wind"], [1.0, 1.2, 1.1, 0.8, 0.3, 2.0])
    a, b = (ConceptGradient(kv, d, {"sun", "rain"}, n_pca=2, use_unit_beta=u) for u in (True, False))
    assert math.isclose(np.linalg.norm(a.beta_unit), 1.0) and np.allclose(np.asarray(b.beta) / np.linalg.norm(b.beta), a.beta_unit)
    assert b.beta_unit == b.beta and np.allclose(a.beta, b.beta)  # without it the direction keeps its length
