"""Line chunks against one pass over all chunks in order."""

import hashlib
import random

from flagtide.llm import line_dedup as L

SF = "/root/testdata/sf0.001"


def brute(rows, c=L.Chunking()):
    """Rows in order of their id; a text stays with the first row that has it."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines, kept = (text or "").split("\n"), []
        for a, b in L.chunk_bounds(lines, c):
            chunk = "\n".join(lines[a:b])
            if b - a == 1 or chunk not in seen:
                kept += lines[a:b]
            if b - a > 1:
                seen.add(chunk)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def got(df):
    return sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in df.collect())


def test_documents(spark):
    from flagtide.llm import queries  # noqa: F401
    from flagtide.llm.registry import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert got(QUERIES["op8_line_dedup"](spark, SF)) == want
    assert sum(w[2] for w in want) > 0


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(400)]
    chunks = {tuple(lines[a:b]) for a, b in L.chunk_bounds(lines, L.Chunking())}
    for at in (0, 7, 200):
        changed = lines[:at] + ["inserted"] + lines[at:]
        again = {tuple(changed[a:b]) for a, b in L.chunk_bounds(changed, L.Chunking())}
        assert len(chunks - again) <= 8
    assert all(2 <= len(c) <= 32 for c in list(chunks)[:-1]) or len(chunks) > 1


def test_odd_rows(spark):
    shared = "\n".join(f"shared {i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, "\n" * 500), (4, "\n" * 500), (5, shared), (6, "own line\n" + shared + "\nend"),
            (7, shared + "\n" + shared), (8, "x" * 300_000), (9, "é\né\r\né")]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n_lines int, row string")
    result = L.remove_repeated(docs)
    assert got(result) == brute(rows)
    twice = spark.createDataFrame([(5, shared), (5, shared), (None, "a\nb\nc")], "doc_id long, text string")
    assert [r.n_removed for r in L.remove_repeated(twice).collect()] == [0, 0, 0]
    assert L.remove_repeated(docs.limit(0)).count() == 0


def test_equal_digests_are_compared_by_bytes(spark):
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "a\nb"), (4, "e\nf\ng")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.remove_repeated(docs, L.Chunking(digest_bits=1))) == brute(rows)


def test_null_ids_repeated_rows_and_other_id_types(spark):
    shared = "\n".join(f"shared {i}" for i in range(40))
    rows = [(None, shared), (None, shared), (3, shared), (3, shared), (9, "own\n" + shared)]
    docs = spark.createDataFrame([(i, t, "mine", 1.5) for i, t in rows], "doc_id int, text string, twin string, first double")
    result = {}
    for r in L.remove_repeated(docs).collect():
        result.setdefault(r.doc_id, []).append((r.n_lines, r.n_removed))
    # without an id comes first, and rows that repeat id and text are one document
    assert result[None] == [(40, 0)] * 2
    assert len(result[3]) == 2 and result[3][0] == result[3][1] and result[3][0][1] > 30
    assert result[9][0][0] == 41 and result[9][0][1] > 0
