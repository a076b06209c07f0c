"""Language ID, toxicity and quality: exact parts by brute force, learned parts by held-out rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_lattice_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"])}
    rng = np.random.default_rng(1)
    p = rng.random((len(vocab) + 1, 2))

    def brute(text, lang):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in vocab:
                out += p[vocab[text[:k]], lang] * brute(text[k:], lang)
            elif k == 1:
                out += p[len(vocab), lang] * brute(text[1:], lang)
        return out

    parts = ["▁abab", "▁", "▁babxab", "b", "xx"]
    lattice = langid.Lattice(parts, langid.Trie(vocab))
    assert np.allclose(np.exp(lattice.total(np.log(p))), [[brute(t, g) for g in (0, 1)] for t in parts])
    eps, counts = 1e-6, np.array([2.0, 1, 3, 1, 5])
    own = p[:, :1]
    numeric = []
    for i in range(len(vocab) + 1):
        up = own.copy()
        up[i] *= 1 + eps
        numeric.append((lattice.total(np.log(up))[:, 0] - lattice.total(np.log(own))[:, 0]) @ counts / eps)
    assert np.allclose(lattice.expected(np.log(own), counts), numeric, rtol=1e-3, atol=1e-3)


def test_a_word_is_summed_as_a_whole():
    """Long words, and pieces of any length: against a plain sum over beginnings."""
    vocab = {"▁": 0, "a": 1, "ab": 2, "abababababababab": 3, "b": 4}
    p = np.array([[0.1], [0.2], [0.1], [0.05], [0.3], [0.01]])
    word = "▁" + "ab" * 40 + "ñ" + "ab" * 9
    a = [1.0] + [0.0] * len(word)
    for i in range(1, len(word) + 1):
        for k in range(1, 17):
            if k <= i and word[i - k : i] in vocab:
                a[i] += a[i - k] * p[vocab[word[i - k : i]], 0]
            elif k == 1:
                a[i] += a[i - 1] * p[5, 0]
    assert np.isclose(langid.Lattice([word], langid.Trie(vocab)).total(np.log(p))[0, 0], np.log(a[-1]))
    assert langid.Lattice(["▁" + "ab" * 3000], langid.Trie(vocab)).total(np.log(p))[0, 0] < -1000


def test_language_id(spark):
    rows = [(i, "der hund und die katze gehen nach hause", "de", "z") for i in range(20)] + [(i, "the dog and the cat walk home", "en", "z") for i in range(20, 40)]
    rows += [(50, None, "de", "z"), (51, "12 !?", None, "z"), (None, "die katze", None, "z"), (None, "the cat " * 60_000, "en", "z"), (52, "x" * 5000, "en", "z"), (53, "日本 語", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, c0 string")
    vocab = langid.vocabulary()
    langs, p = langid.trained(df, vocab)
    assert langs == ["de", "en"]
    out = langid.identified(df, langs, vocab, p)
    assert out.columns == [*df.columns, "lang_pred", "lang_score"]
    by = {(r.doc_id, (r.text or "")[:5]): (r.lang_pred, r.lang_score) for r in out.collect()}
    assert len(by) == len(rows) and by[50, ""] == ("und", 0.0) and by[51, "12 !?"] == ("und", 0.0)
    assert by[None, "die k"][0] == "de" and by[None, "the c"][0] == "en" and all(0 <= s <= 1 for _, s in by.values())
    assert langid.identified(df.limit(0), langs, vocab, p).count() == 0
    langs, p = langid.trained(df.limit(0), vocab)
    assert {r.lang_pred for r in langid.identified(df, langs, vocab, p).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    assert langid.words_of("x² Abc½d Ⅳ ① 一二") == ["x", "abc", "d", "一二"]
    docs = [(1, "der hund", "de"), (2, "½ ² ③", None), (3, "der ½ hund", None)]
    df, vocab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), langid.vocabulary()
    langs, p = langid.trained(df, vocab)
    out = langid.identified(df, langs, vocab, p)
    assert {r.doc_id: (r.lang_pred, r.lang_score) for r in out.collect()} == {1: ("de", 1.0), 2: ("und", 0.0), 3: ("de", 1.0)}


def test_language_accuracy(spark):
    out = langid.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = out.where("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right >= 0.97 * n


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    trans, start, sizes = rng.normal(size=(2, 2)), 0.3, np.array([3, 0, 1, 5])
    e = rng.normal(size=9)
    starts = np.array([0, 3, 3, 4])
    p, clean, steps = toxicity.marginals(e, starts, sizes, trans, start, pairs=True)
    want, moved, none = np.zeros(9), np.zeros((2, 2)), np.zeros(4)
    for i, (s, k) in enumerate(zip(starts, sizes)):
        if not k:
            continue
        total, own, pair = 0.0, np.zeros(k), np.zeros((2, 2))
        for m in range(1 << k):
            y = [m >> i & 1 for i in range(k)]
            w = np.exp(start * y[0] + sum(e[s + i] * y[i] for i in range(k)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            none[i] += w * (m == 0)
            total += w
            own += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += w
        want[s : s + k] = own / total
        moved += pair / total
        none[i] = np.log(none[i] / total)
    assert np.allclose(p, want) and np.allclose(steps.sum(1).reshape(2, 2), moved)
    assert np.allclose(toxicity._sums(clean, starts, sizes), none)


def test_fit_climbs_the_likelihood_of_labels(monkeypatch):
    """The documents' labels, by the exact chance of no toxic token, are far likelier after all rounds than before them."""
    rng = random.Random(5)
    segments = []
    for d in range(200):
        ws = [f"w{rng.randrange(60)}" for _ in range(12)]
        if d % 4 == 0:
            at = rng.randrange(11)
            ws[at : at + 2] = ["so", rng.choice(["vile", "nasty"])]
        elif d % 4 == 1:
            ws[rng.randrange(12)] = "so"
        segments.append((d, int(d % 4 == 0), ws))
    got = []
    for rounds in (0, 2, toxicity.ROUNDS):
        monkeypatch.setattr(toxicity, "ROUNDS", rounds)
        got.append(sum(-np.log1p(np.exp(-x if y else x)) for x, y in toxicity.logits(toxicity.fitted(segments), segments).values()))
    assert got[0] < 2 * got[1] and got[1] < 2 * got[2]


def test_emissions_are_sums_of_weights():
    rng = random.Random(7)
    tokens = [[rng.choice(["a", "b", "beginning", "ünd", "x9"]) for _ in range(k)] for k in (3, 0, 1, 8)]
    model = toxicity.Model({"a": 1, "begin*": 2}, np.array([]), np.zeros((2, 2)), 0.0, (1.0, 0.0))
    features = toxicity.Features(model.units)
    model.weights = np.random.default_rng(1).normal(size=features.size)
    starts, sizes = toxicity._bounds([len(t) for t in tokens])
    want = model.weights[features.of(tokens, starts, sizes)].sum(0)
    assert np.allclose(model.words().emissions(tokens, starts, sizes), want)


def test_neighbours_are_features():
    features = toxicity.Features({"a": 1, "b": 2})
    starts, sizes = toxicity._bounds([2, 0, 1])
    at = features.of([["a", "b"], [], ["b"]], starts, sizes)
    assert at[0].tolist() == [1, 2, 2] and (at[1] - 3).tolist() == [0, 1, 0] and (at[2] - 6).tolist() == [2, 0, 0]
    assert all(lo <= row.min() and row.max() < hi for row, lo, hi in zip(at, features.base, features.base[1:]))
    assert features["x1é"][2] != features["x1e"][2] and features["begins"][3:] == features["beginsx"][3:]
    assert features["\ud800"][0] == 0


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    segments = []
    for d in range(300):
        ws = [rng.choice(words) for _ in range(20)]
        if d % 3 == 0:
            ws[rng.randrange(20)] = rng.choice(["vile", "nasty"])
        segments.append((d, int(d % 3 == 0), ws))
    assert toxicity.lexicon(segments) == {"vile", "nasty"}
    model = toxicity.fit(segments, 0.3)
    text = "İ w1 w2 VILE, w3 " + "w5 " * 30_000 + "nasty!"
    rows = [(1, text, "x"), (2, "w1 w2 w3", "x"), (3, None, "x"), (4, "", "x"), (None, "nasty", "x"), (5, " ... ", "x"), (5, " ... ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = sorted((r.doc_id or 0, r.score, r.spans) for r in toxicity.scored(df, model).collect())
    assert [s >= 0.5 for _, s, _ in out] == [True, True, False, False, False, False, False] and all(0 <= s <= 1 for _, s, _ in out)
    at = [tuple(map(int, x.split(":"))) for x in out[1][2].split(",")]
    assert [text[a:b] for a, b in at] == ["VILE", "nasty"]
    assert toxicity.scored(df.limit(0), model).count() == 0
    empty = toxicity.fit([], 0.0)
    assert all(r.score < 0.5 for r in toxicity.scored(df, empty).collect())


def test_toxicity_held_out(spark):
    out = toxicity.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.95 * len(out)


def test_context_sums():
    index = quality.index_vectors()
    ids, doc = np.array([5, 6, 7, 5, 9]), np.array([0, 0, 0, 0, 1])
    want = np.zeros_like(index, np.float64)
    for i in range(5):
        for j in range(5):
            if 0 < abs(i - j) <= quality.NEAR and doc[i] == doc[j]:
                want[ids[i]] += index[ids[j]]
    assert np.allclose(quality.context_sums(ids, doc, index), want)


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.op9_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.93 * len(out)
    model = quality.trained(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "word " * 200_000, "x"), (3, "a", "x"), (3, "a", "x")], "doc_id long, text string, score string")
    got = quality.scored(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[1] == {r.doc_id: r.score for r in got}[2]
    assert quality.scored(odd.limit(0), model).count() == 0
    none = quality.trained(docs.limit(0), labels)
    assert all(r.score == 0.5 for r in quality.scored(odd, none).collect())


def test_shape_of_a_whole_token():
    assert quality.shape("a" * 50 + "!!!0") == "\x00aa!!0"
