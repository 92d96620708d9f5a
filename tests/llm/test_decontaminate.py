"""Wu-Manber search against plain comparison of every window at every place."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from flagtide.llm import decontaminate as D
from flagtide.llm.terms import BLOCK_BYTES, numbered, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[a:a + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, names = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[a:a + n])):
                    hit.update(range(a, a + n))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=1, max_size=6, unique_by=tuple),
       st.lists(st.integers(-1, 3), max_size=700))
def test_search_finds_every_occurrence(patterns, text):
    p = D.Patterns(np.array(patterns, dtype=np.int32))
    ends, rows = p.find(np.array(text, dtype=np.int32))
    want = {(i + 2, r) for i in range(len(text) - 2) for r, q in enumerate(patterns) if text[i:i + 3] == q}
    assert sorted(zip(ends.tolist(), rows.tolist())) == sorted(want)


def test_blocks_of_no_pattern_are_jumped_over():
    rng = np.random.default_rng(1)
    p = D.Patterns(rng.integers(0, 50, (20, 10)).astype(np.int32))
    looked = []
    shift = p._block_at
    p._block_at = lambda text, ends: looked.append(len(ends)) or shift(text, ends)
    text = rng.integers(-1, 5_000, 100_000).astype(np.int32)
    p.candidates(text)
    assert sum(looked) < len(text) / 7  # nine words at most


def test_words_of_long_texts_in_parts():
    rng = random.Random(4)
    text = " ".join(rng.choice(["aB", "é9", "x-y", "Ünit"]) for _ in range(600_000)).encode()
    parts = list(words(text))
    assert len(parts) > 2
    flat = [w for p in parts for w in p]
    assert flat == [w.encode() for w in WORD.findall(lowered(text.decode()))]
    assert numbered(text, {b"ab": 7}).tolist() == [7 if w == b"ab" else -1 for w in flat]


def planted(rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["É1", "ñ"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(60)]
    docs = []
    for i in range(200):
        w = some(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            _, passage = rng.choice(items)
            a = rng.randrange(len(passage))
            w[len(w) // 2:len(w) // 2] = passage[a:a + rng.randrange(8, 30)]
        docs.append((i, rng.choice([" ", "-", "\n", "_ "]).join(w).upper() if i % 3 else " ".join(w)))
    return docs, [(i, " ".join(w)) for i, w in items if len(w) > 2 or i < 3]


def test_planted_passages_in_one_block_and_in_many(spark):
    docs, items = planted(random.Random(8))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert 10 < sum(w[5] for w in want)
    for size in (BLOCK_BYTES, 400):
        assert got(D.contamination(d, i, block_bytes=size)) == want


def test_odd_rows(spark):
    ten = " ".join(f"t{i}" for i in range(10))
    docs = [(1, None), (2, ""), (3, ten), (3, ten), (None, "x " + ten.upper()), (5, "é" * 40_000), (6, ten.replace(" ", "x")),
            (7, "a b " * 60_000 + ten), (8, "short"), (9, "SHORT, short!"), (10, ten[:-1])]
    items = [(1, ten), (1, ten), (1, "short"), (None, "b a"), (3, None), (4, " .,- "), (10, ten + " more")]
    d = spark.createDataFrame([(i, t, "n", 5, [1]) for i, t in docs],
                              "doc_id long, text string, id string, n_words int, spans array<int>")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    for size in (BLOCK_BYTES, 40):
        assert got(D.contamination(d, q, block_bytes=size)) == brute(docs, items)
    found = D.find(d, q).where("doc_id = 7").first()  # "b a" all along, then the ten words
    assert ([tuple(s) for s in found.spans], found.items) == ([(1, 119_999), (120_000, 120_010)], ["", "1"])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(D.contamination(d.limit(0), q)) == []
    assert got(D.contamination(d, q.limit(0))) == brute([(1, "a b")], [])


def test_plan_has_no_shuffle(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert "Exchange" not in D.contamination(d, q)._jdf.queryExecution().executedPlan().toString()
