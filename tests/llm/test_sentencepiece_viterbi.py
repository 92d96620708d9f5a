"""Segmentation against a plain Viterbi over whole texts, and exact round trips."""

import random
import zlib

import numpy as np
import pytest

from flagtide.llm import sentencepiece_viterbi as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return V.Pieces.load(V.public_model())


def plain(pieces, text):
    """Best path over the whole marked text, character by character."""
    if not text:
        return []
    t = (" " + text).replace(V.MARKER, "￿￿").replace(" ", V.MARKER)
    table = {pieces.surface[i].decode().replace(" ", V.MARKER): i for i in range(len(pieces.surface))
             if pieces.surface[i] and i not in set(pieces.byte_ids)}
    longest = max(map(len, table))
    best = [0.0] + [None] * len(t)
    back = [None] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        for b in range(max(0, e - longest), e):
            i = table.get(t[b:e])
            if i is None and e - b == 1:
                s, ids = pieces.unknown, [pieces.byte_ids[x] for x in t[b:e].encode()]
            elif i is not None:
                s, ids = pieces.score[i], [i]
            else:
                continue
            if best[e] is None or best[b] + s > best[e]:
                best[e], back[e] = best[b] + s, (b, ids)
    out, e = [], len(t)
    while e:
        b, ids = back[e]
        out = ids + out
        e = b
    odd = [pieces.byte_ids[x] for x in "￿￿".encode()]
    return V._replaced(out, odd, [pieces.byte_ids[x] for x in V.MARKER.encode()])


TEXTS = ["", " ", "a", "  two  spaces ", "Hello world\nnew line\ttab", "日本語 \U0001F600 \x00\x01", "▁ literal ▁▁",
         "ñandú çelebi", "x" * 300, " " * 40, "￾ end", "a▁b c", "tokenization of tokenizers"]


def test_equals_plain_viterbi(pieces):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abct he▁é日 \U0001F600in") for _ in range(60)) for _ in range(60)]
    for text, data in zip(texts, pieces.encode_batch(texts)):
        ids = np.frombuffer(data, dtype="<u4")
        assert ids.tolist() == plain(pieces, text), text
        assert pieces.decode(ids) == text


def test_double_array_finds_all_keys():
    rng = random.Random(4)
    keys = {bytes(rng.choice(b"abc\xff") for _ in range(rng.randrange(1, 7))): 0 for _ in range(500)}
    keys = {k: i for i, k in enumerate(keys)}
    trie = V.DoubleArray(keys)
    data = bytes(rng.choice(b"abc\xff") for _ in range(3000))
    at, size, value = trie.matches(np.frombuffer(data, dtype=np.uint8), np.arange(3000, 0, -1))
    want = {(i, n, keys[data[i:i + n]]) for i in range(3000) for n in range(1, 7) if data[i:i + n] in keys and i + n <= 3000}
    assert set(zip(at.tolist(), size.tolist(), value.tolist())) == want


def test_documents(spark, pieces):
    from flagtide.llm import queries  # noqa: F401
    from flagtide.llm.registry import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_sentencepiece_viterbi"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.round_trip for r in rows)
    for r in [r for r in rows if len(docs[r.doc_id]) < 900][:40]:
        ids = plain(pieces, docs[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_odd_rows(spark):
    texts = [None, *TEXTS, "long " * 100_000, "y" * 200_000, "a", "a"]
    df = spark.createDataFrame([(None if i == 3 else i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    encoded = V.encode(df)
    rows = encoded.collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in V.decode(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if i != 3)
    assert V.encode(df.limit(0)).count() == 0
