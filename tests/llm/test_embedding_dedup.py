"""Embedding links against all cosines, and the measured recall at the threshold."""

import numpy as np
import pytest

from flagtide.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    good = {k: np.array(v, dtype=float) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    keys = list(good)
    unit = {k: v / np.sqrt((v * v).sum()) for k, v in good.items()}
    for a in keys:
        for b in keys:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                parent[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((i, n[k], least.get(root(k))) for k, (i, _) in enumerate(rows) if i is not None)


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in df.collect() if r.vec_id is not None)


def cloud(rng, n, dim, spread):
    """Random vectors, some in bunches at all cosines around the threshold."""
    base = rng.standard_normal((n // 4, dim))
    return np.concatenate([base] + [base[: n // 8] + rng.uniform(0, spread, (n // 8, 1)) * rng.standard_normal((n // 8, dim))
                                    for _ in range(6)]).astype(np.float32)


@pytest.mark.parametrize("chunk", [256, 7])
def test_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    vectors = np.concatenate([cloud(rng, 400, 32, 0.3), np.tile(rng.standard_normal(32), (60, 1)).astype(np.float32)
                              + 0.01 * rng.standard_normal((60, 32)).astype(np.float32)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900 + i, [float(x) for x in vectors[5]]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    result = E.near_duplicates(df, recall=0.999999)
    assert got(result) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in result.collect())


def test_recall_at_the_threshold(spark):
    """Pairs at cosines just above 0.9, in a table large enough for several grids."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.92, (3000, 1))
    z = c * x + np.sqrt(1 - c * c) * y
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, z]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    r = {v.vec_id: v.n_links for v in E.near_duplicates(df).collect()}
    assert sum(r[i] for i in range(3000)) >= 0.985 * 3000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1e-30, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]),
            (None, None)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, weight int, node string")
    result = E.near_duplicates(df)
    assert result.count() == len(rows)
    assert got(result) == brute(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_ties_at_the_threshold(spark):
    """Cosines of exactly the threshold link, smaller ones do not."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [3.0, 4.0, 0.0]), (3, [3.0, 0.0, 4.0]), (4, [3.0 - 1e-9, 4.0, 0.0]),
            (5, [-3.0, -4.0, 0.0]), (6, [6.0, 8.0, 0.0]), (7, [5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    result = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df, cosine=0.6, recall=0.999999).collect()}
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    links = {i: sum(cos(v, w) >= 0.6 for j, w in rows if j != i) for i, v in rows}
    assert {i: n for i, (n, _) in result.items()} == links and links[1] == 4


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, [1.0, 0.2]), (None, [1.0, 0.2]), (4, [1.0, 0.2]), (4, [1.0, 0.2]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows],
                               "vec_id long, embedding array<double>, n_links int, cells int, vector int")
    result = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=repr)
    assert result == sorted([(None, 3, 4, True)] * 2 + [(4, 3, 4, True)] * 2 + [(2, 0, 2, True)], key=repr)
