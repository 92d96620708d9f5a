"""Presence masks against the scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from flagtide.llm import lexical_search as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, top=20):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
                    for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
            spark.createDataFrame(items, "item_id long, text string"))


def zipf(rng, n, size=400):
    return " ".join(f"T{min(int(rng.paretovariate(0.6)), size)}" for _ in range(n))


def test_equal_to_scores_of_all_documents(spark):
    rng = random.Random(3)
    docs = [(i, zipf(rng, rng.randrange(0, 120))) for i in range(900)]
    items = [(i, zipf(rng, rng.choice([1, 3, 20, 90, 400]))) for i in range(25)]
    want = brute(docs, items)
    assert len(want) > 300
    d, q = frames(spark, docs, items)
    assert got(S.rank(d, q)) == want
    assert got(S.rank(d, q, block_bytes=300, block_docs=37)) == want  # many blocks of both kinds


def test_ties_take_the_smaller_ids_across_blocks(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(1000 + i, f"other {i}") for i in range(300)]
    items = [(1, "words words"), (2, "same"), (3, "other 7")]
    d, q = frames(spark, docs, items)
    for block in (1 << 14, 16):
        assert got(S.rank(d, q, block_docs=block)) == brute(docs, items)


def test_search_stops_early():
    rng = np.random.default_rng(5)
    n = 4_000
    doc = np.concatenate([np.sort(rng.choice(n, size, replace=False)) for size in (3500, 2000, 40, 30)])
    term = np.repeat(np.arange(4), [3500, 2000, 40, 30])
    p = S.Postings(np.full(n, 50), doc, term, np.ones(len(doc), dtype=np.int64), n, 50 * n)
    factor = np.array([100, 700, 5000, 5400])
    at, score = S.search(p, p.of(np.arange(4)), factor, 20, 1, 0, n)
    want = np.zeros(n, dtype=np.int64)
    np.add.at(want, doc, factor[term] * p.part[np.argsort(np.argsort(term, kind="stable"), kind="stable")])
    best = np.sort(want)[::-1][:20]
    assert np.sort(score)[::-1][:20].tolist() == best.tolist()
    assert len(at) < 400


def test_masks_are_the_terms_of_a_document():
    rng = np.random.default_rng(9)
    has = rng.random((130, 70)) < 0.2
    doc, term = np.nonzero(has)
    p = S.Postings(np.full(130, 9), doc, term, np.ones(len(doc), dtype=np.int64), 130, 1170)
    lists = p.of(np.arange(70))
    for a, z in ((0, 130), (17, 90)):
        places, mask = S.masks(p, lists, a, z)
        assert places.tolist() == [i for i in range(a, z) if has[i].any()]
        for i, row in zip(places.tolist(), mask.tolist()):
            assert [j for j in range(128) if row[j // 64] >> (j % 64) & 1] == np.flatnonzero(has[i]).tolist()


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "É a É"), (4, "É a É"), (None, "a b"), (None, "a b"), (6, "x " * 200_000),
            (7, "A-B_c"), (8, "longer text with a and b and c")]
    items = [(1, "a"), (1, "a"), (1, "b"), (None, "c É"), (5, None), (6, ""), (7, "x x X"), (8, "nowhere")]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, rank int, score string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    assert got(S.rank(d, q)) == brute(docs, items)


def test_empty_tables(spark):
    d, q = frames(spark, [(1, "a")], [(1, "a")])
    for df in (S.rank(d.limit(0), q), S.rank(d, q.limit(0)), S.rank(d.where("doc_id > 1"), q)):
        assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.collect() == []
