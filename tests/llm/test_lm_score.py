"""Pseudo-likelihood: token by token evaluation, gradients, and what training learns."""

import math
import random

import numpy as np

from flagtide.llm import lm_score as L


def sample(seed, n, order=True):
    """Texts over 60 words in which every other word follows from its neighbours."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = []
        for i in range(60):
            a = rng.randrange(20)
            words += [f"a{a}", f"b{a % 5}" if order else f"b{rng.randrange(5)}"]
        out.append(" ".join(words))
    return out


def test_training_and_scoring(spark):
    texts = sample(1, 800)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = L.fit(docs)
    good = spark.createDataFrame(list(enumerate(sample(2, 30))), "doc_id long, text string")
    bad = spark.createDataFrame(list(enumerate(sample(3, 30, order=False))), "doc_id long, text string")
    mean = lambda df: np.mean([r.mean_log_likelihood for r in L.score(df, model).collect()])
    counts = np.array([r.n for r in model.counts.collect()])
    share = counts / counts.sum()
    unigram = float((share * np.log(share)).sum())
    assert mean(good) > unigram + 0.3  # held-out texts, better than without context
    assert mean(good) > mean(bad) + 0.3


def plain_score(model, counts, words):
    """Token by token; ``counts`` of all words."""
    net, v = model.net, model.vocab
    head = dict(zip(v.head.tolist(), v.head_class.tolist()))
    of = lambda w: head.get(w, v.own + w % (v.classes - v.own))
    c, total = [of(w) for w in words], 0.0
    for i, w in enumerate(words):
        h = net.params["hidden_bias"].astype(float).copy()
        for k, o in enumerate((-2, -1, 1, 2)):
            h += net.params["embed"][k][c[i + o] if 0 <= i + o < len(c) else v.classes]
        z = np.tanh(h) @ net.params["out"] + net.params["out_bias"]
        p = np.exp(z - z.max())
        total += math.log(p[c[i]] / p.sum()) + math.log(counts.get(w, 0) + 0.5) - v.log_total[c[i]]
    return total


def test_scores_are_those_of_single_tokens(spark, monkeypatch):
    """Also with nearly all words outside the cache, and words never seen."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(rng.randrange(40))) for _ in range(200)]
    for head in (L.HEAD, 30):
        monkeypatch.setattr(L, "HEAD", head)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        model = L.fit(docs)
        counts = {r.word: r.n for r in model.counts.collect()}
        plain: dict = {}
        for t in texts:
            for w in L.hashes_of([t])[0].tolist():
                plain[w] = plain.get(w, 0) + 1
        assert counts == plain
        more = texts[:60] + ["never seen words w1 w2", "w1 w1 never never"]
        df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
        for r in L.score(df, model).collect():
            want = plain_score(model, counts, L.hashes_of([more[r.doc_id]])[0].tolist())
            assert abs(r.log_likelihood - want) < 1e-3 * max(1, r.n_tokens)


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 64)
    rows = [(i * 7919 - 10 ** 6, 1 + 5000 // (i + 1)) for i in range(700)]
    counts = spark.createDataFrame(rows, "word long, n long")
    v = L.Vocabulary.of(counts)
    words = np.array([w for w, _ in rows])
    of_word, inside, known = v.classified(words)
    n = np.array([n for _, n in rows])
    inside = np.where(known, inside, np.log(n + 0.5) - v.log_total[of_word])
    sums = np.bincount(of_word, weights=np.exp(inside), minlength=v.classes)
    sums[v.own:] += 0.5 / np.exp(v.log_total[v.own:])  # the word never seen
    assert np.allclose(sums, 1, atol=1e-5) and 55 < known.sum() <= 64


def test_everything_grows_with_the_words():
    sizes = [L.sizes_for(n) for n in (0, 100, 10_000, 10 ** 6, 10 ** 9)]
    assert sizes == sorted(sizes) and len(set(sizes)) == 5
    weights = [sum(int(np.prod(s)) for s in L.shapes(c, h).values()) for c, _, h in sizes]
    assert weights == sorted(weights)


def test_text_of_two_documents_scores_apart(spark):
    """Words that stand in two documents are likelier than those of one, however rare."""
    rng = random.Random(9)
    new = lambda k: " ".join(f"{k}{rng.randrange(10 ** 9)}" for _ in range(80))
    twice = [new("t") for _ in range(40)]
    texts = twice + twice + [new("o") for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in L.score(docs, L.fit(docs)).collect()}
    assert min(got[i] for i in range(80)) > max(got[i] for i in range(80, len(texts)))


def test_words_are_hashed_alike_wherever_they_stand():
    rng = random.Random(8)
    words = ["a", "é", "日本", "long" * 40, "x\u00a0y", "\x1c", "ab", "ba", "aab"]
    texts = [None, "", "  "] + ["".join(rng.choice(words + [" ", "\n", "\t\r", "\x0b\x0c"]) for _ in range(rng.randrange(60)))
                                for _ in range(200)]
    buckets, counts = L.hashes_of(texts)
    split = [(t or "").encode().split() for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    of: dict = {}
    for word, b in zip((w for s in split for w in s), buckets.tolist()):
        assert of.setdefault(word, b) == b
    assert len(set(of.values())) == len(of)
    assert L.hashes_of([])[0].size == 0


def test_gradient():
    rng = np.random.default_rng(5)
    net = L.Network.start(np.zeros(60), 20)
    around, target = rng.integers(0, 61, (50, 4)), rng.integers(0, 60, 50)
    loss = lambda f: -float(net.with_values(f).forward(around)[1][np.arange(50), target].mean())
    before = net.flat()
    copy = net.with_values(before)
    copy.step(around, target)
    assert loss(copy.flat()) < loss(before)
    # the step is RATE * g / sqrt(g^2 + 1e-4): recover g and compare with differences
    move = (before - copy.flat()) / L.RATE
    g = move * math.sqrt(1e-4) / np.sqrt(np.maximum(1e-12, 1 - move * move))
    for i in rng.choice(len(before), 40, replace=False):
        e = np.zeros(len(before))
        e[i] = 0.02
        assert abs((loss(before + e) - loss(before - e)) / 0.04 - g[i]) < 2e-3


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "two words"), (5, "w " * 250_000)]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, n_tokens double")
    result = L.score(df, L.fit(df)).collect()
    assert sorted(r.n_tokens for r in result) == [0, 0, 0, 1, 1, 2, 250_000]
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in result)
    assert all(math.isfinite(r.log_likelihood) for r in result)
    assert L.score(df.limit(0), L.fit(df.limit(0))).count() == 0
