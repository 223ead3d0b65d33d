"""Word vector files, normalisation, stop words and the analyzer."""

import gzip

import numpy as np
import pytest
from conftest import rows

from tiltfield import load_analyzer, load_embeddings, load_stopwords, normalize_kv, preprocess_texts

LINES = ["one 1 0.5 -2", "two 0 1 0", "one 9 9 9", "three 2 2 1"]


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("zipped", [True, False])
def test_text(spark, tmp_path, header, zipped):
    text = "\n".join((["4 3"] if header else []) + LINES) + "\n"
    path = tmp_path / ("v.vec.gz" if zipped else "v.txt")
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    got = rows(load_embeddings(spark, str(path)), "rank")
    assert [(r["word"], r["rank"], r["vec"]) for r in got] == [("one", 0, [1, 0.5, -2]), ("two", 1, [0, 1, 0]), ("three", 2, [2, 2, 1])]
    assert np.allclose(got[2]["vec_unit"], np.array([2, 2, 1]) / 3)


@pytest.mark.parametrize("zipped", [True, False])
def test_binary(spark, tmp_path, zipped):
    m = np.random.default_rng(0).normal(size=(3, 4)).astype("<f4")
    raw = b"3 4\n" + b"".join(w.encode() + b" " + v.tobytes() + b"\n" for w, v in zip(["eins", "zwei", "drei"], m))
    path = tmp_path / ("v.bin.gz" if zipped else "v.bin")
    path.write_bytes(gzip.compress(raw) if zipped else raw)
    got = rows(load_embeddings(spark, str(path)), "rank")
    assert [r["word"] for r in got] == ["eins", "zwei", "drei"] and np.allclose([r["vec"] for r in got], m)


def test_parquet_and_pickles(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0])], "word string, rank int, vec array<float>")
    df.write.parquet(str(tmp_path / "v.parquet"))
    assert load_embeddings(spark, str(tmp_path / "v.parquet")).first().word == "a"
    with pytest.raises(ValueError):
        load_embeddings(spark, "v.kv")


def test_abtt_is_numpys(spark):
    v = np.random.default_rng(1).normal(size=(30, 5)).astype(np.float32)
    kv = spark.createDataFrame([(f"w{i}", i, x.tolist()) for i, x in enumerate(v)], "word string, rank int, vec array<float>")
    got = np.array([r["vec"] for r in rows(normalize_kv(kv, abtt_m=2), "rank")])
    u = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    c = u - u.mean(0)
    top = np.linalg.svd(c, full_matrices=False)[2][:2]
    want = c - c @ top.T @ top
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-6)
    plain = np.array([r["vec"] for r in rows(normalize_kv(kv), "rank")])
    assert np.allclose(plain, u, atol=1e-6)


def test_stopwords(spark, tmp_path):
    assert "the" in load_stopwords("en") and "und" in load_stopwords("german")
    (tmp_path / "pl.txt").write_text("i\nOraz\n\n")
    assert load_stopwords("pl", spark=spark, path=str(tmp_path / "pl.txt")) == ["i", "oraz"]
    with pytest.raises(LookupError):
        load_stopwords("pl")
    (tmp_path / "none.txt").write_text("\n")
    with pytest.raises(ValueError):
        load_stopwords("pl", spark=spark, path=str(tmp_path / "none.txt"))


def test_preprocess(spark):
    text = "See https://a.b/c now!  The 12 cats, abc1 @me run. Ok"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    a, b, c = rows(preprocess_texts(df, stopwords=["the"]), "doc_id")
    # a URL goes with the marks that touch it
    assert a["sents_lemmas"] == [["see", "now"], ["cats", "abc1", "run"], ["ok"]]
    assert [text[s["start"] : s["end"]] for s in a["sent_char_spans"]] == a["sents_surface"]
    assert len(a["token_to_sent"]) == len(a["doc_lemmas"]) and b["doc_lemmas"] == c["doc_lemmas"] == []
    table = spark.createDataFrame([("cats", "cat"), ("run", "the")], "surface string, lemma string")
    lem = rows(preprocess_texts(df, stopwords=["the"], lemmas=table), "doc_id")
    assert "cat" in lem[0]["doc_lemmas"] and "run" not in lem[0]["doc_lemmas"] and lem[1]["doc_lemmas"] == []


def test_plugged_in_analyzer(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = rows(preprocess_texts(df, load_analyzer(lambda t: [(t, 0, len(t), t.split())] if t else []), stopwords=["b"]), "doc_id")
    assert got[0]["doc_lemmas"] == ["a"] and got[1]["sents_surface"] == []
