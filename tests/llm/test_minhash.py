"""Near-duplicates against all pairs of full shingle sets."""

import random
import re

import pytest

from flagtide.llm import minhash
from flagtide.llm.components import components
from flagtide.llm.minhash import Settings

SF = "/root/testdata/sf0.001"


def brute(docs, s):
    """{row: (n_shingles, component)} over (doc_id, text) rows with distinct ids."""
    sets = {}
    for i, t in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(s.words, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if s.per * both >= s.least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("s", [Settings(3, 85), Settings(5, 80)])
def test_documents(spark, s):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], s)
    result = minhash.near_duplicates(docs, s)
    assert set(result.columns) == {"doc_id", "n_shingles", "component_id", "kept", "row_key"}
    assert got(result) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in result.collect())


def test_large_family_with_outliers(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1_000_000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10_000)}" for _ in range(80))) for i in range(30)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(docs, Settings(3, 85))) == brute(rows, Settings(3, 85))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "word " * 50_000),
            (8, "word " * 60_000), (9, "É b c d"), (10, "é b c d"), (11, "a b c d e"), (11, "a b c d e"), (None, "q r s")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, component_id int")
    result = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, Settings(3, 85)).collect()]
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 7), 9: (2, 9),
            10: (2, 10), 11: (3, 11)}
    assert len(result) == len(rows)
    for i, n, c, kept in result:
        if i is None:
            assert kept
        else:
            assert (n, c) == want[i] and kept == (i == c)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.keep_representatives(docs).columns == docs.columns


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: root(x) for x in parent}
    assert components(df.limit(0)).count() == 0
