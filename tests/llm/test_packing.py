"""Packing: tokens against the public tokenizer, placement against plain best-fit decreasing."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flagtide.llm import packing


def plain_bfd(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(window - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_one_by_one_placement(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 17, 64])
    lengths = [min(window, max(1, int(rng.expovariate(1 / rng.choice([2, 8, 30]))))) for _ in range(rng.randint(0, 400))]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    runs = packing.best_fit_decreasing(dict(histogram), window)
    bins = defaultdict(list)
    for length, count in histogram.items():
        rows = [i for i in range(len(runs.length)) if runs.length[i] == length]
        rows.sort(key=lambda i: runs.first[i])
        for rank in range(count):
            i = max(r for r in rows if runs.first[r] <= rank)
            nth = rank - runs.first[i]
            bins[runs.bin[i] + nth // runs.each[i]].append((runs.offset[i] + nth % runs.each[i] * length, length))
    for content in bins.values():  # gapless from 0
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(window - sum(n for _, n in c) for c in bins.values()) == plain_bfd(lengths, window)
    assert len(bins) == runs.bins


def test_piece_bounds():
    assert packing.piece_bounds(1, 4) == [(0, 1)]
    assert packing.piece_bounds(4, 4) == [(0, 4)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]
    assert packing.piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_ids_are_those_of_the_public_tokenizer(spark):
    enc = packing.Encoder.public()
    texts = ["", " ", "a  b", "x\n y", "it's 12 naïve — ok\t\t", "a<|endoftext|>b", "é" * 3000, " " * 50_000 + "z",
             "ab" * 40_000, "\x1c 　 x", "日本語 テキスト"]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert enc.ids(text).tolist() == enc.reference.encode(text, add_special_tokens=False).ids, text[:50]


def test_odd_rows(spark):
    long = "word and " * 3000
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long), (4, long), (None, "x"), (5, "hello world")]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, sequence_id int, rank int")
    got = packing.pack_documents(docs, with_ids=True).collect()
    enc = packing.Encoder.public()
    whole = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        whole[r.doc_id].append(r)
    for i, t in rows:
        n = len(enc.ids(t or "")) + 1
        copies = sum(x == i for x, _ in rows)
        assert sum(r.length for r in whole[i]) == n * copies
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    for content in spots.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_query_over_documents(spark):
    from flagtide.llm import queries  # noqa: F401
    from flagtide.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op10_best_fit_packing"](spark, sf).collect()
    tok = packing.Encoder.public().reference
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = []
    for i, t in docs.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.piece_bounds(len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == len(plain_bfd([w[3] for w in want], 2048))
