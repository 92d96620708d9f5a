"""Repeated passages against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flagtide.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 2, dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                covered[i + 1:i + 1 + length] = True
        kept = bytes(b for b, c in zip(d, covered[1:]) if not c)
        out.append((len(d), len(d) - len(kept), int((covered[1:] & ~covered[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_index_marks_what_counting_marks(seed):
    rng = random.Random(seed)
    alphabet = [b"ab", b"abcd", bytes(range(256))][seed % 3]
    base = bytes(rng.choice(alphabet) for _ in range(rng.choice([40, 300])))
    texts = []
    for _ in range(60):
        a = rng.randrange(len(base))
        t = bytearray(base[a:a + rng.randrange(1, 300)])
        for _ in range(rng.choice([0, 0, 1, 3])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(alphabet)
        texts.append(bytes(t))
    length = rng.choice([3, 10, 30])
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    want = [[i for i in range(len(t) - length + 1) if count[t[i:i + length]] > 1] for t in texts]
    assert [x.tolist() for x in S.long_matches(texts, length)] == want
    index = S.RunLengthIndex(texts)
    assert index.runs <= index.n


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in df.collect())


def test_documents(spark):
    from flagtide.llm import queries  # noqa: F401
    from flagtide.llm.registry import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, *w) for (i, _), w in zip(docs, brute([t for _, t in docs], 200)))
    assert rows(QUERIES["op1_suffix_dedup"](spark, SF)) == want


def _made(rng):
    letters = "etaoin shrdlu, é\n"
    new = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [new(n) for n in (199, 200, 260, 900)]
    texts = [None, "", "x" * 199, " " * 3000, "ab" * 700, new(5000)]
    for _ in range(120):
        parts = [new(rng.randrange(0, 400))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), new(rng.randrange(0, 300))]
        texts.append("".join(parts))
    return texts + texts[5:9] + [passages[3], passages[3][10:-10]]


def windows(texts, length):
    return {(i, s + j) for i, s, n, *_ in S.spans([t.encode() for t in texts if t], length) for j in range(n)}


def test_buffers_cover_every_window_once(monkeypatch):
    texts = _made(random.Random(1))
    whole = windows(texts, 200)
    monkeypatch.setattr(S, "BUFFER", 700)
    assert windows(texts, 200) == whole


@pytest.mark.parametrize("most, length", [(1_000, 200), (3, 200), (1, 200), (2, 60), (1, 450)])
def test_made_texts(spark, monkeypatch, most, length):
    """Also with keys of more contexts than a block takes, down to single windows."""
    monkeypatch.setattr(S, "BLOCK_CONTEXTS", most)
    texts = _made(random.Random(most))
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, kept_text string, row int")
    result = S.remove_repeats(docs, length).cache()
    want = sorted((i, *w) for i, w in enumerate(brute(texts, length)))
    assert rows(result) == want
    for r in result.collect():
        assert len(r.kept_text.encode()) >= r.n_bytes - r.n_removed
    result.unpersist()


def test_parts_hold_every_window_once_and_equal_windows_share_a_key():
    rng = random.Random(6)
    length, passage = 60, bytes(rng.choice(b"ab ") for _ in range(300))
    texts = [bytes(rng.choice(b"ab ") for _ in range(80)) + passage + bytes(rng.choice(b"ab ") for _ in range(80)) for _ in range(6)]
    for width in (37, 10, 3, 1):
        key_of = {}
        for i, s, n, place, anchor, _ in S.spans(texts, length):
            seen = []
            for first, m, at, key, _ in S.parts(texts[i], s, n, place, str(anchor), width, length):
                assert first + at == s + place and m <= width
                seen += range(first, first + m)
                for w in range(first, first + m):
                    key_of.setdefault(texts[i][w:w + length], set()).add(key)
            assert sorted(seen) == list(range(s, s + n))
        assert all(len(k) == 1 for k in key_of.values())


def test_one_passage_in_very_many_contexts(spark, monkeypatch):
    """More contexts than a block takes, at its own setting; no step makes a row per window."""
    rng = random.Random(12)
    letters = "etaoin shrdlu"
    new = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = new(260)
    texts = [new(210) + passage + new(210) for _ in range(2_500)]
    sizes = []
    split = S._split
    monkeypatch.setattr(S, "_split", lambda *a: sizes.append(a[2]) or split(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert rows(S.remove_repeats(docs)) == sorted((i, *w) for i, w in enumerate(brute(texts, 200)))
    assert sizes == [45, 12, 3, 1][:len(sizes)] and sizes


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abc def\n") for _ in range(400))
    long = "".join(rng.choice("etaoin shrdlu") for _ in range(S.BUFFER + 500)) + passage
    texts = [long, passage + "x", "y" + passage]
    docs = spark.createDataFrame([(i, t, 77, "mine", 5) for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_bytes int, kept_text string, twin int")
    want = sorted((i, *w) for i, w in enumerate(brute(texts, 200)))
    assert rows(S.remove_repeats(docs)) == want
    own = S.remove_repeats(docs, prefix="own_").collect()
    assert sorted((r.doc_id, r.own_n_bytes, r.own_n_removed, r.own_n_spans, r.own_kept_sha256) for r in own) == want
    assert {(r.n_bytes, r.kept_text, r.twin) for r in own} == {(77, "mine", 5)}


def test_odd_rows(spark):
    text = "é" * 400
    docs = spark.createDataFrame([(1, text), (1, text), (None, "q" * 10), (2, None), (2, None)], "doc_id long, text string")
    got = rows(S.remove_repeats(docs))  # repeated rows and rows without an id are documents of their own
    empty = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(1, 800, 800, 1, empty)] * 2 + [(2, 0, 0, 0, empty)] * 2
                         + [(-1, 10, 0, 0, hashlib.sha256(b"q" * 10).hexdigest())])
    assert S.remove_repeats(docs.limit(0)).count() == 0
