"""Training-data operators: brute force, round trips, held-out accuracy, and the odd inputs."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tiltfield.llm import bpe, common, eliasfano, fingerprints, langid, lmscore, mixing, ngramjoin, queries, substrings, topk, toxicity, urlfilter
from tiltfield.llm.eliasfano import EliasFano, pack, unpack

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wörd and other words " * 30_000
#: Nulls everywhere, empty, blank and letterless texts, repeated rows and ids, one very long text.
ODD = [
    (1, "The cat sat on the mat.", "en", "a", 23), (1, "The cat sat on the mat.", "en", "a", 23), (1, "another text here", "en", "a", None), (None, "no id here", None, None, None),
    (None, "no id here", None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t", "en", "b", 3), (5, "?!", "", "", 2), (6, LONG, "en", "b", len(LONG)),
    (7, "İé ñ ß 中文 😀", "fr", None, 9),
]
EXTRA = ["key", "block", "h", "row", "score", "shard", "pos", "spans", "new"]


def odd(spark, empty=False):
    df = spark.createDataFrame([] if empty else ODD, DOC)
    for c in EXTRA:  # clashing names
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


# --- odd inputs: every operator ---

OPERATORS = {
    "lm": lmscore.lm_score, "langid": langid.language_id, "fingerprints": fingerprints.fingerprint, "bpe": bpe.encode_documents, "substrings": substrings.repeated_passages,
    "join": ngramjoin.jaccard_join, "mixing": mixing.mix_rows, "toxicity": lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "1 AS toxic")),
    "url": lambda d: urlfilter.filter_urls(d.selectExpr("doc_id AS page_id", "text AS url")), "topk": lambda d: topk.top_k(d.selectExpr("doc_id AS vec_id", "array(1.0, CAST(n_chars AS DOUBLE)) AS embedding")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    got = rows(OPERATORS[name](odd(spark)))
    assert OPERATORS[name](odd(spark, empty=True)).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r.get("doc_id")].append(r)
    if name in ("lm", "langid", "fingerprints", "bpe", "toxicity"):
        assert len(got) == len(ODD) and len(by[1]) == 3 and len(by[None]) == 2
    if name == "lm":
        assert by[2][0]["n_words"] is None and by[3][0]["n_words"] == 0 and by[5][0]["perplexity"] is None and by[6][0]["n_words"] == 120_000
    if name == "langid":
        assert [by[i][0]["pred_lang"] for i in (2, 3, 4, 5)] == ["und"] * 4 and not by[5][0]["accepted"]
    if name == "fingerprints":
        assert by[2][0]["signature"] is None and by[3][0]["signature"] == [] and len(by[6][0]["signature"]) == fingerprints.SAMPLES
    if name == "bpe":
        assert by[2][0]["tokens"] is None and by[3][0]["tokens"] == [] and all(r["decoded_ok"] in (True, None) for r in got)
    if name == "toxicity":
        assert by[2][0]["toxic"] is None and by[3][0]["toxic"] is False and by[3][0]["score"] is None
    if name == "substrings":  # only the long text repeats itself; repeated rows are one document
        assert {r["doc_id"] for r in got} == {6} and any(r["removed"] for r in got)
    if name == "join":
        assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in got) and len(got) == 9
    if name == "mixing":
        assert len(got) <= len(ODD) and len({(r["shard"], r["position"]) for r in got}) == len(got)
    if name == "url":
        assert len(got) == len(ODD) and not any(r["listed"] for r in got)
    if name == "topk":
        assert all(r["query_id"] is not None and r["query_id"] != r["item_id"] for r in got)


def test_words_by_vectors():
    texts = [r[1] or "" for r in ODD] + ["z" * 70_000 + " Ab_c9"]
    h, size, begin = common.word_hashes(texts)
    words = [w for t in texts for w in common.words_of(t)]
    assert list(size) == [len(w) for w in words] and list(np.diff(begin)) == [len(common.words_of(t)) for t in texts]
    names = {}
    assert all(names.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(names.values())) == len(names)


# --- 1: language model ---


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 5), (10, 3), (1000, 10**9), (5000, 4000), (3000, 2**50)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = EliasFano(unpack(np.frombuffer(pack(EliasFano.build(v, "x")), np.uint8)), "x")
        assert (e.get(np.arange(n)) == v).all()
        q, a = rng.integers(0, top + 10, 500), rng.integers(0, n + 1, 500)
        b = np.minimum(n, a + rng.integers(0, n + 1, 500))
        assert (e.successor(q, a, b) == [i + np.searchsorted(v[i:j], x) for x, i, j in zip(q, a, b)]).all()


def test_select_in_words():
    rng = np.random.default_rng(2)
    full = (1 << 64) - 1
    for w in [1, 1 << 63, full, full - 1, full >> 1, *rng.integers(0, full, 60, np.uint64, True).tolist(), *(rng.integers(0, full, 20, np.uint64) & rng.integers(0, full, 20, np.uint64) & rng.integers(0, full, 20, np.uint64)).tolist()]:
        places = [p for p in range(64) if w >> p & 1]
        assert eliasfano._select_in_words(np.full(len(places), w, np.uint64), np.arange(len(places))).tolist() == places


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(5)
    for n, top in ((1, 0), (1, 5), (10, 30), (1000, 10**9), (4000, 4100), (3000, 2**50)):
        v = np.sort(rng.choice(top + 1, n, replace=False)) if top < 10**5 else np.unique(rng.integers(0, top + 1, n))
        e = EliasFano(unpack(np.frombuffer(pack(EliasFano.build(v, "x")), np.uint8)), "x")
        q = np.concatenate([rng.integers(0, top + 10, 300), rng.choice(v, 300)])
        a = rng.integers(0, len(v) + 1, 600)
        b = np.minimum(len(v), a + rng.integers(0, len(v) + 1, 600))
        want = [i + np.searchsorted(v[i:j], x) for x, i, j in zip(q, a, b)]
        assert e.find(q, a, b).tolist() == [k if k < j and v[k] == x else -1 for x, j, k in zip(q, b, want)]


def brute_lm(texts):
    docs = [common.words_of(t) if t else [] for t in texts]
    one = Counter(w for d in docs for w in d)
    total, full = sum(one.values()), sum(1 for d in docs if d)
    ok = lambda w: w == "<s>" or one[w] >= 2
    lines = [["<s>", *d] for d in docs]
    two = {k: c for k, c in Counter(p for s in lines for p in zip(s, s[1:]) if ok(p[0]) and ok(p[1])).items() if c >= 2}
    three = {k: c for k, c in Counter(p for s in lines for p in zip(s, s[1:], s[2:]) if p[:2] in two and p[1:] in two).items() if c >= 2}
    count = lambda v: full if v == "<s>" else one[v]
    q = lambda x: float(lmscore.VALUE[lmscore.quantise(np.array([x]))[0]])
    held1, held2 = defaultdict(float), defaultdict(float)
    for (v, _), c in two.items():
        held1[v] += c - lmscore.DISCOUNT
    for (u, v, _), c in three.items():
        held2[u, v] += c - lmscore.DISCOUNT

    def p(s, i):
        w, v = s[i], s[i - 1]
        x = one[w] / total if ok(w) else 1 / total
        if ok(v):
            x = (q((two[v, w] - lmscore.DISCOUNT) / count(v)) if (v, w) in two else 0) + q(1 - held1[v] / count(v)) * x
            if i > 1 and (s[i - 2], v) in two:
                u = s[i - 2]
                x = (q((three[u, v, w] - lmscore.DISCOUNT) / two[u, v]) if (u, v, w) in three else 0) + q(1 - held2[u, v] / two[u, v]) * x
        return x

    return [sum(math.log(p(s, i)) for i in range(1, len(s))) for s in lines]


@pytest.mark.parametrize("mass", [4_000_000, 700])
def test_lm_is_brute_force(spark, documents, monkeypatch, mass):
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", mass)  # small shards split words over several
    trie = lmscore.train(documents)
    assert mass > 1000 or trie.split
    got = {r["doc_id"]: r["log_prob"] for r in rows(lmscore.score(documents, trie))}
    texts = rows(documents.select("doc_id", "text"))
    for r, want in zip(texts, brute_lm([r["text"] for r in texts])):
        assert abs(got[r["doc_id"]] - want) < 1e-3


# --- 2: language ---


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    out = langid.language_id(docs.where("doc_id % 2 = 1 AND n_chars > 100"), model).join(docs.select("doc_id", "lang"), "doc_id")
    found = rows(out)
    assert np.mean([r["pred_lang"] == r["lang"] for r in found]) > 0.95
    assert np.mean([r["accepted"] for r in found]) > 0.99
    assert model.word("qqzzqq") is None or len(model.word("qqzzqq")) == 4  # an unseen word backs off


def test_mostly_foreign_script_is_turned_away(spark):
    made = [(1, "the cat and the dog sat here " * 20, "en"), (2, "le chat et la souris sont ici " * 20, "fr")]
    model = langid.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    texts = ["привет мир " * 19 + "the cat", "привет " * 10, "the cat and the dog привет"]
    got = rows(langid.language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model), "doc_id")
    assert [r["accepted"] for r in got] == [False, False, True]


def test_each_language_has_its_own_sample(spark):
    made = [(i, "the cat and the dog sat here", "en") for i in range(40)] + [(99, "le chat et la souris", "fr")]
    model = langid.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"), train_rows=2)
    assert model.langs == ("en", "fr") and "souris" in model.words and "dog" in model.words


# --- 3: fingerprints ---


def test_collisions_are_generalised_jaccard():
    a, b = Counter(x=5, y=2, z=1, q=9), Counter(x=3, y=4, w=2, q=9)
    table = fingerprints._Draws(4096)
    rate = (table.signature(a) == table.signature(b)).mean()
    keys = a.keys() | b.keys()
    assert abs(rate - sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)) < 0.04
    every, found = fingerprints._Draws(64), {}
    h = {w: fingerprints.HashCache()[w] for w in a}
    for j in range(64):  # sample by sample, from the definition
        value = []
        for w, n in a.items():
            u = lambda lane: float(fingerprints._uniform(np.array([h[w]], np.uint64), lane, 64)[0, j])  # noqa: B023, E731
            r, c, beta = -math.log(u(1) * u(2)), -math.log(u(3) * u(4)), u(5)
            t = math.floor(math.log(n) / r + beta)
            value.append((math.log(c) - r * (t - beta) - r, w, t))
        found[j] = min(value)[1:]
    name = lambda w, t: int(common.mix(np.array([(h[w] + t * 0xD6E8FEB86659FD93) & common.MASK], np.uint64)).view(np.int64)[0])
    assert every.signature(a).tolist() == [name(*found[j]) for j in range(64)]
    tied = fingerprints._Draws(8)
    tied.signature(Counter(x=1, y=1))
    tied.ln_a[:] = 0.5  # all tie: the least name counts, in either order
    assert (tied.signature(Counter(x=1, y=1)) == tied.signature(Counter(y=1, x=1))).all() and (tied.signature(Counter(x=1, y=1)) == tied.name[:2].min(0)).all()
    small = fingerprints._Draws(64, limit=3)  # parts and an emptied table change nothing
    assert (small.signature(a) == fingerprints._Draws(64).signature(a)).all()


def test_signatures_of_many_texts_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["", "?!", "one", *(" ".join(f"w{x}" for x in rng.zipf(1.6, int(rng.integers(1, 300))) % 500) for _ in range(40)), "One, one; Two", "?", ""]
    words = {w for t in texts for w in common.words_of(t)}
    for coarse in (False, True):
        if coarse:  # many equal values: the least name counts
            exact = fingerprints.draws
            monkeypatch.setattr(fingerprints, "draws", lambda *a: ((x := exact(*a))[0].round(), x[1]))
        table = fingerprints._Draws(64)
        table.hash = {w: common.word_hashes([w])[0][0] for w in words}
        for part in (250_000, 37):  # texts go part by part
            monkeypatch.setattr(fingerprints, "PART", part)
            found, n = fingerprints.signatures(texts)
            for t, sig, k in zip(texts, found, n):
                counts = Counter(common.words_of(t))
                assert k == len(counts) and sig.tolist() == (table.signature(counts).tolist() if counts else [])


# --- 4: top-k ---


@pytest.mark.parametrize("dim,block", [(12, 2048), (40, 16)])
def test_topk_is_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, dim)) * rng.lognormal(size=(300, 1))
    x[7] = x[8]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in rows(topk.top_k(table, k=5), "query_id", "rank"):
        got[r["query_id"]].append(r["item_id"])
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for i in range(300):
        assert got[i] == sorted(range(300), key=lambda j: (-s[i, j], j))[:5]
    some = rows(topk.top_k(table, k=5, queries=F.col("id") % 7 == 0), "query_id", "rank")
    assert [(r["query_id"], r["item_id"]) for r in some] == [(i, j) for i in range(0, 300, 7) for j in got[i]]
    bad = [None, [], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None]]
    mixed = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 2.0], [2.0, 1.0], *bad])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["item_id"], r["score"]) for r in rows(topk.top_k(mixed), "query_id")] == [(0, 1, 4.0), (1, 0, 4.0)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


# --- 5: BPE ---


def test_bpe_chunks_and_bytes(spark):
    texts = ["", "it's  a\n\n test 123abc!'s  ", LONG[:9000], "x" * 5000, "ñ'll 'tis 12's\t\tend ", "中文😀 ok" * 300]
    for t in texts:
        whole = bpe.encoding(bpe.RANKS).encode_ordinary(t)
        for size in (1, 7, 100):
            assert bpe.encode(t, size=size) == whole
        assert bpe.decode(whole) == t.encode()
        assert bpe.decode(whole[:3]) == t.encode()[: len(bpe.decode(whole[:3]))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    back = rows(bpe.decode_tokens(bpe.encode_documents(df)), "doc_id")
    assert [bytes(r["raw"]).decode() for r in back] == texts


# --- 6: toxicity ---


def test_kernel_is_its_definition():
    def brute(s, t):
        total = 0.0
        import itertools

        for a in itertools.combinations(range(len(s)), 3):
            for b in itertools.combinations(range(len(t)), 3):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words = ["banana", "bandana", "cabana", "xyz"]
    f = toxicity.dense(words).astype(float)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert abs(f[i] @ f[j] - brute(s, t) / math.sqrt(brute(s, s) * brute(t, t))) < 1e-5


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    machine = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    bad = [u for u in ("idiot", "trash", "pathetic", "stupid", "loser") if machine.score([u])[0] >= 0]
    assert len(bad) >= 4
    assert machine.score(["i**d**i**o**t"])[0] >= 0 and machine.score(["id--------iot"])[0] > machine.bias
    for u in bad:  # an inserted character or a gap everywhere is tolerated
        assert machine.score([u[:2] + "*" + u[2:]])[0] >= 0 and machine.score(["*".join(u)])[0] >= 0
    held = labels.where("doc_id % 2 = 1").selectExpr("doc_id", "toxic AS label")
    test = rows(toxicity.score_documents(docs, machine).join(held, "doc_id").join(docs.select("doc_id", "text"), "doc_id"))
    assert np.mean([r["toxic"] for r in test if not r["label"]]) < 0.02
    plain = [r["toxic"] for r in test if r["label"] and set(common.words_of(r["text"])) & set(bad)]
    assert plain and np.mean(plain) > 0.95
    made = spark.createDataFrame([(1, "you are an i d i o t ."), (2, "a fine and pleasant day")], "doc_id long, text string")
    got = rows(toxicity.score_documents(made, machine), "doc_id")
    assert ("idiot" not in bad or got[0]["toxic"]) and not got[1]["toxic"]


def test_toxicity_learns_rare_languages():
    rng = np.random.default_rng(6)
    plain = [["zu", "wort"], ["lamo", "tibu", "sarei", "polun", "kerad", "mifo", "dusel", "naba", "goriv", "hetul"]]
    forms = [stem + end for stem in ("bomente", "achlich") for end in ("ra", "co", "st", "ung", "pf", "le", "tz", "ver")]

    def text(*more):
        t = [str(w) for w in rng.choice(plain[1], 40)] + [f"{a}{b}" for a, b in zip(rng.choice(plain[1], 20), rng.choice(plain[1], 20))]
        for w in more:
            t.insert(int(rng.integers(1, len(t))), w)
        return " ".join(t)

    # a frequent language's insult is in many texts, each form of the rare ones in a few
    toxic = [text("trash", "moron") for _ in range(150)] + [text(*(forms[(3 * i + j) % 16] for j in range(3))) for i in range(40)]
    clean = [text() for _ in range(300)] + [text(str(rng.choice(["achlich", "bomente", "erachlich"]))) for _ in range(60)]
    machine = toxicity.fit_sentences(toxic, clean)
    assert [u for u in ("trash", "moron", *forms) if machine.score([u])[0] < 0] == []
    assert (machine.score(["achlich", "bomente", *plain[1]]) < 0).all()


# --- 7: substrings ---


def test_cut():
    assert substrings.cut("a b c d e", [(1, 3)]) == "a d e" and substrings.cut("a b", [(0, 2)]) == "" and substrings.cut("a  b\nc", [(2, 3)]) == "a  b\n"


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats_are_brute_force(spark, hot):
    rng = np.random.default_rng(21)
    vocabulary, made = [f"w{i}" for i in range(3000)], []
    passages = [list(rng.choice(vocabulary, int(rng.integers(6, 20)))) for _ in range(5)]
    for i in range(80):
        parts = [list(rng.choice(vocabulary, int(rng.integers(0, 30)))) for _ in range(3)]
        made.append((None if i % 9 == 0 else int(rng.integers(0, 60)), " ".join(parts[0] + passages[i % 5] * (1 + i % 2) + parts[1] + passages[i % 3] + parts[2])))
    made += made[:5]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    seen = defaultdict(list)
    for r in {tuple(r) for r in df.select("doc_id", common.row_key("doc_id", "text"), "text").collect()}:
        k = r[2].split()
        for p in range(len(k) - 7):
            seen[tuple(k[p : p + 8])].append((r[0] is not None, r[0] or 0, r[1], p))
    marked, want = defaultdict(list), Counter()
    for found in seen.values():
        for n, (known, i, key, p) in enumerate(sorted(found)) if len(found) > 1 else ():
            marked[i if known else None, key, n > 0].append(p)
    for (i, _, removed), places in marked.items():
        places.sort()
        cut = [0, *(n for n in range(1, len(places)) if places[n] > places[n - 1] + 8), len(places)]
        want.update((i, places[a], places[b - 1] + 8, removed) for a, b in zip(cut, cut[1:]))
    got = Counter((r["doc_id"], r["start"], r["stop"], r["removed"]) for r in rows(substrings.intervals(df, 8, 4, hot)))
    assert got == want and len(want) > 100


def test_repeats_are_removed_once(spark):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = word(60)
    made = [(1, f"{word(30)} {shared} {word(5)}"), (2, f"{shared} {word(70)}"), (3, word(200)), (4, f"{word(9)} {shared}")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = rows(substrings.repeated_passages(df), "doc_id")
    assert [(r["doc_id"], r["n_tokens"], r["removed"]) for r in got] == [(1, 60, False), (2, 60, True), (4, 60, True)]
    left = {r["doc_id"]: r["text"] for r in rows(substrings.remove_repeats(df))}
    assert shared in left[1] and shared not in left[2] and shared not in left[4] and left[3] == made[2][1]


def test_texts_without_repeats_stay_out_of_the_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    shared, sent, same = word(60), [], substrings._same
    made = [(i, word(80)) for i in range(400)] + [(400, f"{word(3)} {shared}"), (401, f"{shared} {word(3)}")]
    monkeypatch.setattr(substrings, "_same", lambda left, right, how="inner": (sent.append(left.count()), same(left, right, how))[1])
    got = rows(substrings.repeated_passages(spark.createDataFrame(made, "doc_id long, text string")), "doc_id")
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(400, 60), (401, 60)]
    assert 2 <= sent[0] < 100


def test_first_pass_loses_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 900).astype(np.uint64)
    every = substrings.least(substrings.rolling(x, 25), 26)
    assert (every == [substrings.rolling(x, 25)[i : i + 26].min() for i in range(len(every))]).all()


# --- 8: URLs ---


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('h', id, '.org/', id % 7) AS key")
    listed = universe.where("crc32(key) % 9 = 0")
    cascade = urlfilter.build(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.withColumn("got", cascade.column(universe["key"])).where("got <> (crc32(key) % 9 = 0)")
    assert wrong.count() == 0
    nothing = urlfilter.build(listed.where("false"), universe)
    assert universe.where(nothing.column(universe["key"])).count() == 0


# --- 9: n-gram join ---


def brute_groups(made, t=0.5, n=2):
    """doc_id -> (class_id, n_copies, n_links) by comparing all pairs."""
    sets = {}
    for i, text in made:
        w = common.words_of(text)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[k:] for k in range(n))))
    kinds = sorted({s for s in sets.values() if s}, key=lambda s: min(i for i in sets if sets[i] == s))
    near = {s: [z for z in kinds if z != s and len(s & z) / len(s | z) >= t] for s in kinds}
    root = {}
    for s in kinds:
        todo = [] if s in root else [s]
        while todo:
            z = todo.pop()
            if z not in root:
                root[z] = s
                todo += near[z]
    least = {s: min(i for i in sets if sets[i] == s) for s in kinds}
    return {i: (least[root[s]], sum(z == s for z in sets.values()) - 1, len(near[s])) if s else (i, 0, 0) for i, s in sets.items()}


def joined(spark, made, **options):
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in rows(ngramjoin.jaccard_join(df, **options))}


def test_short_shared_and_long_other_words(spark):
    rng = np.random.default_rng(5)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnop"), k))
    made = []
    for i in range(12):  # shared words are short, those of one text long: half of all bigrams are shared
        shared = [word(2) for _ in range(41)]
        made += [(2 * i, " ".join(shared + [word(20) for _ in range(20)])), (2 * i + 1, " ".join(shared + [word(20) for _ in range(20)]))]
    want = brute_groups(made)
    assert sum(x[2] for x in want.values()) == 24
    assert joined(spark, made) == want


@pytest.mark.parametrize("seed,hot,leaf", [(1, 8192, 64), (2, 3, 4), (3, 5, 64)])
def test_join_is_brute_force(spark, monkeypatch, seed, hot, leaf):
    monkeypatch.setattr(ngramjoin, "LEAF", leaf)
    monkeypatch.setattr(ngramjoin.RTree.__init__, "__defaults__", (None, leaf, 3))
    rng = np.random.default_rng(seed)
    made = []
    for g in range(12):
        base = [f"w{x}" for x in rng.zipf(1.3, int(rng.integers(1, 90))) % 400]
        for _ in range(int(rng.integers(1, 25))):
            t = [w if rng.random() > rng.choice([0, 0.05, 0.3]) else f"v{rng.integers(60)}" for w in base]
            made.append((len(made), " ".join(t[int(rng.integers(0, 1 + len(t) // 4)) :])))
    made += [(len(made), ""), (len(made) + 1, "?!")]
    want = brute_groups(made)
    assert joined(spark, made, hot=hot) == want
    pairs = rows(ngramjoin.similar_pairs(spark.createDataFrame(made, "doc_id long, text string"), hot=hot))
    degree = Counter(r[k] for r in pairs for k in ("doc_a", "doc_b"))
    first = {}  # the least id of those with one set stands for it
    for i, t in made:
        w = common.words_of(t)
        first.setdefault(frozenset(zip(w, w[1:])) if len(w) > 1 else tuple(w), i)
    assert degree == Counter({i: want[i][2] for i in first.values() if want[i][2]}) and all(0.5 <= r["jaccard"] < 1 for r in pairs)


def test_large_blocks_and_rtree(monkeypatch):
    monkeypatch.setattr(ngramjoin, "GROUPS", 32)
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 2**62, 40).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.where(rng.random(40) < rng.uniform(0, 0.3), rng.integers(0, 2**62, 40).astype(np.uint64), b)) for b in base for _ in range(70)]
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    point = ngramjoin._points(flat, np.repeat(np.arange(len(sets)), size), len(sets))
    size = size.astype(np.int64)
    got = set()
    for x, y in ngramjoin.RTree(point, size, leaf=4, fanout=3).join(0.5):
        keep = np.minimum(point[x], point[y]).sum(1) >= (size[x] + size[y]) / 3
        got |= {tuple(sorted(p)) for p in zip(x[keep].tolist(), y[keep].tolist())}
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(j, i) for i in range(len(sets)) for j in range(i) if jac(sets[i], sets[j]) >= 0.5}
    assert want <= got and len(got) < len(sets) ** 2 / 3
    names = np.arange(len(sets)).repeat(2).astype(np.int64).view("V16")
    bits = ngramjoin._Bits(names, sets)
    i, j = np.array(sorted(want)).T
    assert (bits.overlap(i, j) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]).all()
    half = np.stack([np.arange(len(sets)) // 2, np.arange(len(sets))], 1).ravel().astype(np.int64).view("V16")
    twins = ngramjoin._Bits(half, sets)  # two sets to each half of a name
    x, y = np.triu_indices(len(sets) // 2)
    i, j, _ = twins.links(x, y, 0.5)
    found = list(zip(twins.order[i].tolist(), twins.order[j].tolist()))
    assert len(found) == len(set(found)) and {tuple(sorted(p)) for p in found} == {tuple(sorted(p)) for p in want}


def test_pairs_gather_where_their_lesser_set_leads(spark):
    rng = np.random.default_rng(3)
    made = sorted({(int(min(x)), int(max(x))) for x in rng.integers(0, 90, (150, 2)) if x[0] != x[1]})
    home = {p: p[0] for p in made}
    for _ in range(ngramjoin.STEPS):
        low = defaultdict(list)
        for (_, b), h in home.items():
            low[b].append(h)
        home = {(a, b): min([h, *low[a]]) for (a, b), h in home.items()}
    df = ngramjoin.gather(spark.createDataFrame(made, "a long, b long"), common.shared_dir(spark))
    together, want = defaultdict(set), defaultdict(set)
    for r in rows(df):
        together[r["block"]].add((r["a"], r["b"]))
    for p, h in home.items():
        want[h].add(p)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, want.values())) and len(want) < 60
    joins = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins <= 4, joins  # not one more for each use of each step


def test_sketches_lose_nothing():
    rng = np.random.default_rng(9)
    sets = []
    for n in (1, 2, 31, 33, 90, 200, 700):
        base = rng.integers(0, 2**62, n).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(n) < s], rng.integers(0, 2**62, int(m * n)).astype(np.uint64)])) for s in (1.1, 0.9, 0.6) for m in (0, 0.2, 1)]
    sets = [x for x in sets if len(x)]
    size = np.array([len(x) for x in sets])
    bits, length = ngramjoin.sketches(np.concatenate(sets), size)
    parts = [x.tobytes() for x in np.split(bits, np.cumsum(length)[:-1])]
    x, y = np.triu_indices(len(sets), 1)
    want = np.array([len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.5 for i, j in zip(x, y)])
    names = rng.permutation(10 * len(sets))[: len(sets)].astype(np.int64)
    got = ngramjoin._Sketches(names, size, parts).may(names[x], names[y], 0.5)
    assert (got | ~want).all() and (got & ~want).sum() < 0.05 * (~want).sum()
    half = names[np.arange(len(sets)) // 2]  # two sets to a name: never ruled out
    assert ngramjoin._Sketches(half, size, parts).may(half[x], half[y], 0.5).all()


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    near = base.copy()
    near[10] = "other"
    made = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base)), (9, " ".join(base)), (8, "all by itself here"), (7, None), (7, None), (None, " ".join(base)), (4, "?"), (2, "again and again"), (2, "again and again")]
    df = spark.createDataFrame([(*m, "x") for m in made], "doc_id long, text string, key string")
    kept = rows(ngramjoin.drop_near_duplicates(df), "doc_id")
    assert [r["doc_id"] for r in kept] == [2, 3, 4, 7, 7, 8] and kept[0].keys() == {"doc_id", "text", "key"}
    found = {(r["doc_a"], r["doc_b"]) for r in rows(ngramjoin.similar_pairs(df))}
    assert found == {(3, 5)}
    got = {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in rows(ngramjoin.jaccard_join(df))}
    assert got == {5: (3, 2, 1), 9: (3, 2, 1), None: (3, 2, 1), 3: (3, 0, 1), 8: (8, 0, 0), 7: (7, 0, 0), 4: (4, 0, 0), 2: (2, 0, 0)}
    named = spark.createDataFrame([("b", "one two three"), ("a", "one two three")], "doc_id string, text string")
    assert {(r["doc_id"], r["class_id"]) for r in rows(ngramjoin.jaccard_join(named))} == {("a", "a"), ("b", "a")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (7, 7)]
    got = {r["node"]: r["root"] for r in rows(ngramjoin.components(spark.createDataFrame(edges, "a long, b long"), common.shared_dir(spark)))}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[105] == 100


# --- 10: mixing ---


def test_splitting_tree_is_exact():
    q = np.array([1000, 37, 0, 512])
    for shards in (1, 2, 7, 64):
        s = mixing.split(q, shards)
        assert s.shape == (shards, 4) and (s.sum(0) == q).all() and s.min() >= 0 and np.ptp(s.sum(1)) <= shards.bit_length()
    # a leaf's share of a source follows the hypergeometric mean
    many = np.array([mixing.split(np.array([50, 150]), 2, seed)[0, 0] for seed in range(400)])
    assert abs(many.mean() - 25) < 0.6 and abs(many.var() - 50 * 0.25 * 150 / 199) < 2


def test_mix_meets_the_quotas(spark):
    made = [(i, f"t{i}", "abcd"[min(3, i % 7)]) for i in range(4000)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    weights = {"a": 0.5, "b": 0.25, "c": 0.25}
    got = rows(mixing.mix_rows(df, weights, block_rows=4, shard_rows=256))
    count = Counter(r["source"] for r in got)
    have = Counter(s for _, _, s in made)
    plan = mixing.make_plan(dict(have), weights, 4, 256)
    assert count == {s: min(have[s], 4 * int(n)) for s, n in zip(plan.sources, plan.quotas) if n}
    assert abs(count["a"] / len(got) - 0.5) < 0.02 and len({r["doc_id"] for r in got}) == len(got)
    by = Counter((r["shard"], r["source"]) for r in got)
    for k, row in enumerate(plan.shards):
        for s, n in zip(plan.sources, row):
            assert abs(by[k, s] - 4 * n) <= 3
    assert mixing.mix_rows(df, {}).count() == 0
    again = rows(mixing.mix_rows(df.repartition(7), weights, block_rows=4, shard_rows=256))
    assert sorted(map(str, again)) == sorted(map(str, got))  # the draw doesn't depend on partitions


@pytest.mark.parametrize("cell,weights", [(65536, None), (50, {"a": 1.0, None: 0.5, "b": 2.0})])
def test_draw_is_brute_force(spark, monkeypatch, cell, weights):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    rng = np.random.default_rng(3)
    made = [(i, f"t{i}", ["a", "b", "c", None][int(rng.integers(0, 4)) if i % 3 else 0]) for i in range(1500)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(5)
    hashes = {r[0]: (r[1], r[2]) for r in df.select("doc_id", mixing._order(mixing.SEED), F.xxhash64(F.lit(mixing.SEED + 1), mixing._order(mixing.SEED))).collect()}
    plan = mixing.make_plan(dict(Counter(s for _, _, s in made)), weights, 4, 64)
    want = {}
    for k, s in enumerate(plan.sources):
        line = sorted((hashes[i][0], i) for i, _, x in made if x == s)
        for shard, blocks in enumerate(plan.shards[:, k].tolist()):
            want |= {i: shard for _, i in line[: 4 * blocks]}
            line = line[4 * blocks :]
    got = rows(mixing.mix_rows(df, weights, block_rows=4, shard_rows=64))
    assert {r["doc_id"]: r["shard"] for r in got} == want and len(got) == len(want)
    inside = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["shard"], r["position"])):
        inside[r["shard"]].append((hashes[r["doc_id"]][1], r["doc_id"]))
    assert len(inside) > 3 and all(v == sorted(v) for v in inside.values())


def test_a_tiny_source_thins_no_other(spark):
    plan = mixing.make_plan({"hot": 50_000, **{f"s{i}": 1000 for i in range(19)}, None: 30})
    assert all(16 * q >= n for q, n in zip(plan.quotas, [{"hot": 50_000, None: 30}.get(s, 1000) for s in plan.sources]))
    made = [(i, f"t{i}", None if i < 5 else "ab"[i % 10 == 0]) for i in range(3000)]
    got = rows(mixing.mix_rows(spark.createDataFrame(made, "doc_id long, text string, source string"), shard_rows=256))
    assert sorted(r["doc_id"] for r in got) == list(range(3000)) and len({r["shard"] for r in got}) > 1


def test_mixing_takes_one_python_worker_a_task(spark, monkeypatch):
    docs = odd(spark)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)  # whose rows pass through workers of their own
    for out in (mixing.mixed_documents(docs), mixing.mixed_documents(docs.withColumn("source", F.lit(None).cast("string")))):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert out.count() == docs.count()


# --- cost of the first two stages ---


def test_language_scorer_scores_no_known_word_again(monkeypatch):
    rng, asked = np.random.default_rng(5), []
    grams = {g: {} for g in langid.GRAMS} | {1: {c: (-1.0, -2.0) for c in "thecatdogü "}, 2: {"th": (-1.5, -0.5), "at": (-0.25, -3.0)}}
    model = langid.Model(("x", "y"), {"the": (-0.5, -4.0), "cat": (-1.25, -1.0), "über": (-2.0, -0.125), "zzz": (-3.0, -3.5)}, grams)
    some = ["the", "The,", "(CAT)", "über!", "ÜBER", "zzz", "the-cat", "cat's", "thth", "batx.", "qqq", "12", "--", "7the7", "ÉÉ"]
    texts = [" ".join(rng.choice(some, n)) for n in (0, 1, 5, 40, 300)]

    def brute(text):
        row = np.zeros(5)
        for w in langid._LETTERS.findall(text.lower()):
            v = model.word(w)
            row += [1, 0, 0, 0, 0] if v is None else [1, 1, any(c in grams[1] for c in w), *v]
        return row

    wanted = [brute(t) for t in texts]
    word = langid.Model.word
    monkeypatch.setattr(langid.Model, "word", lambda self, w: asked.append(w) or word(self, w))
    for limit in (4, 1000):
        scorer = langid._Scorer(model, limit)
        assert np.allclose([scorer.text(t) for t in texts], wanted, atol=1e-9)
    asked.clear()
    langid._Scorer(model).text("the The, (CAT) über! ÜBER zzz 7the7 12 --")
    assert not asked


def test_ngram_sets_are_found_of_few_texts_at_once(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(i % 300)) for i in range(2000)] + ["", "one", LONG]
    sizes, hashes = [], ngramjoin.word_hashes
    monkeypatch.setattr(ngramjoin, "word_hashes", lambda part: sizes.append(sum(map(len, part[:-1]))) or hashes(part))
    grams, size = ngramjoin._Grams(2).many(texts)
    assert max(sizes) < 1 << 18
    alone = [ngramjoin._Grams(2).many([t]) for t in texts]
    assert (grams == np.concatenate([g for g, _ in alone])).all() and size.tolist() == [int(n[0]) for _, n in alone]
    assert [len(x) for x in ngramjoin._Grams(2).many([])] == [0, 0]
