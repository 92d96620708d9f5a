"""Integer codes against plain squared distances in Python integers."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from flagtide.llm import vector_codes as V


def plain_nearest(x, book):
    d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
    return d.index(min(d)), min(d)


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [min(V.LARGEST, max(-V.LARGEST, math.floor(256 * c))) for c in v], label) for i, v, label in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    step = width // parts
    cut = lambda v, p: v[p * step:(p + 1) * step]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds if kept else 0):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(plain_nearest(cut(v, p), books[p])[0], []).append(cut(v, p))
            for e, members in held.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded, totals = [], {}
    for i, v, label in kept:
        found = [plain_nearest(cut(v, p), books[p]) for p in range(parts)]
        error = min(V._LONG, sum(d for _, d in found))
        coded.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
        totals[label] = totals.get(label, 0) + error
    return sorted(((i, c, e, min(V._LONG, totals[label]), digest) for i, c, e, label in coded), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def test_walsh_rows_are_orthogonal_and_in_sequency_order():
    for n in (1, 2, 4, 8, 32):
        h = V.walsh(n)
        assert (h @ h.T == n * np.eye(n, dtype=np.int64)).all()
        assert (h[:, 1:] != h[:, :-1]).sum(axis=1).tolist() == list(range(n))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 70), st.integers(0, 10 ** 6), st.sampled_from([3, 300, 1 << 40, 1 << 53]))
def test_nearest_entry(width, entries, seed, most):
    rng = random.Random(seed)
    row = lambda: [rng.randint(-most, most) for _ in range(width)]
    book, rows = [row() for _ in range(entries)], [row() for _ in range(20)]
    rows += book[:5]
    entry, error = V.nearest(np.array(rows), np.array(book))
    assert list(zip(entry.tolist(), map(int, error))) == [plain_nearest(r, book) for r in rows]


def test_equal_to_plain_distances(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 0.3) for _ in range(48)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 9]], None if i % 7 == 0 else i % 4) for i in range(500, 0, -1)]
    assert got(V.encode(frame(spark, rows))) == brute(rows)
    few = dict(parts=4, entries=5, rounds=3)
    assert got(V.encode(frame(spark, rows), **few)) == brute(rows, **few)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [None, 1.0], 1), (4, [nan], 1), (5, [1.0, -inf], 2), (6, [0.5] * 16, None),
            (7, [0.5] * 16, None), (7, [0.5] * 16, None), (None, [-0.001] * 3, 2), (9, [1.0] * 40, 2), (9, [-1.0] * 40, 2),
            (10, [1e30, -1e30, 3e9], 3), (11, [-0.0, 1e-9], 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, label int, code string, id int")
    assert got(V.encode(df)) == brute(rows)


def test_empty_and_all_left_out(spark):
    assert got(V.encode(frame(spark, [(1, [1.0], 1)]).limit(0))) == []
    assert got(V.encode(frame(spark, [(1, None, 1), (2, [float("nan")], 1)]))) == []
    assert got(V.encode(frame(spark, [(1, [], 1)]))) == brute([(1, [], 1)])


def test_one_label_and_equal_vectors(spark):
    rows = [(i, [0.25, -0.25] * 8, 5) for i in range(300)]
    assert got(V.encode(frame(spark, rows))) == brute(rows)
