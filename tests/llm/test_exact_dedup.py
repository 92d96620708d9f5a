"""Streaming exact dedup against plain grouping, and its state over several runs."""

import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from flagtide.llm import exact_dedup as E
from flagtide.llm.common import shared_folder

SF = "/root/testdata/sf0.001"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[lowered(t)]), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()), key=repr)


ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "Éa"), (5, "éa"), (6, None), (7, ""), (8, "x" * 200_000),
        (9, "X" * 200_000), (10, "İ"), (11, "i̇"), (12, "one"), (12, "one"), (None, "none"), (None, "NONE"), (None, "one")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, True, "z") for i, t in ROWS], "doc_id long, text string, kept boolean, digest string")
    assert got(E.dedup(docs)) == brute(ROWS)
    assert E.dedup(docs.limit(0)).count() == 0
    kept = E.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        (i for i, keep, _, k, _ in brute(ROWS) if k), key=repr)


def test_different_texts_under_one_digest(spark):
    """A digest of four bits: every hit is told apart by its bytes."""
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2)).cast("binary")
    rows = [(i, f"text {i % 400}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.dedup(docs, digest=weak).collect())
    assert result == sorted(r[:4] for r in brute(rows))


def test_state_goes_on_with_later_documents(spark):
    base = shared_folder(spark, "test_state")
    first = spark.createDataFrame([(1, "a"), (5, "A"), (2, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(3, "a"), (4, "c")], "doc_id long, text string")
    for docs in (first, later):
        E.fingerprints(docs).write.mode("append").parquet(f"{base}/fingerprints")
        E.fold(spark, f"{base}/fingerprints", f"{base}/state")
    assert sorted((r.keep_id, r.group_size) for r in E.read_state(spark, f"{base}/state").collect()) == [(2, 1), (4, 1), (5, 3)]


def test_query_equals_its_oracle(spark):
    from flagtide.llm import queries  # noqa: F401
    from flagtide.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    res = con.execute(ORACLES["op7_exact_dedup"])
    want = sorted(res.fetchall())
    df = QUERIES["op7_exact_dedup"](spark, SF)
    assert df.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, df.collect())) == want


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = E.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_copy_of_every_text(spark):
    rows = [*((i, t, "z") for i, t in ROWS), (12, "ONE", "y"), (12, "other", "y"), (None, None, "y"), (None, "none", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    left = E.keep_one_copy(docs)
    assert left.columns == docs.columns
    got_ = sorted(((r.doc_id, lowered(r.text)) for r in left.collect()), key=repr)
    keep = {}
    for i, t, _ in rows:
        keep[lowered(t)] = max(i or -1, keep.get(lowered(t), -1))
    assert got_ == sorted(((i if i >= 0 else None, t) for t, i in keep.items()), key=repr)
    assert E.keep_one_copy(docs.limit(0)).count() == 0
