"""Every stage of the pipeline against a brute-force version of it."""

import pytest

import corpus_pipeline as P
from flagtide.llm import packing, suffix_dedup, toxicity
from flagtide.llm.common import written
from flagtide.llm.minhash import Settings
from test_minhash import brute as near_brute
from test_packing import plain_bfd
from test_suffix_dedup import brute as repeats_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in toxicity.score(stages[0], model).collect()}
    assert set(after) == {i for i in before if not scored[i]}


def test_exact(stages):
    before, after = rows(stages[1]), rows(stages[2])
    keep = {}
    for i, r in before.items():
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        keep[t] = max(i, keep.get(t, i))
    assert set(after) == set(keep.values()) and all(after[i] == before[i] for i in after)


def test_near(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = near_brute([(i, r.text) for i, r in before.items()], Settings(5, 80))
    assert set(after) == {i for i, (_, c) in want.items() if i == c}


def test_repeats(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    ids = sorted(before)
    for i, (n, removed, _, _) in zip(ids, repeats_brute([before[i].text for i in ids], 200)):
        left = len((after[i].text or "").encode())
        assert n - removed <= left <= n - removed + 6 * (removed > 0) * 4
        if not removed:
            assert after[i] == before[i]
        else:
            assert after[i].n_chars == len(after[i].text)


def test_packing(stages):
    docs, pieces = rows(stages[4]), stages[5].collect()
    enc = packing.Encoder.public()
    lengths = [n for r in docs.values() for _, n in packing.piece_bounds(len(enc.ids(r.text or "")) + 1, 2048)]
    assert sorted(p.length for p in pieces) == sorted(lengths)
    assert len({p.sequence_id for p in pieces}) == len(plain_bfd(lengths, 2048))


def test_odd_rows(spark):
    rows_ = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "same text " * 60, "en", "s", 1),
             (4, "SAME text " * 60, None, "s", 2), (4, "SAME text " * 60, None, "s", 2), (None, "x y z", "de", "s", 3),
             (5, "é" * 300 + "a", "fr", "t", 301), (6, "b" + "é" * 300, "fr", "t", 301)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"kept": "1", "row_key": "2", "ranges": "'q'", "n_bytes": "77", "kept_text": "'own'", "kept_sha256": "'z'",
             "notes": "map('a', 1)"}
    df = docs.selectExpr("*", *(f"{v} as {c}" for c, v in extra.items()))
    for _, stage in P.STAGES[:4]:
        df = written(stage(spark, df, SF))
        assert df.columns == [*docs.columns, *extra]
    left = df.collect()
    assert {r.doc_id for r in left} >= {None, 4, 5, 6}
    assert all((r.kept, r.n_bytes, r.kept_text, r.kept_sha256, r.notes) == (1, 77, "own", "z", {"a": 1}) for r in left)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = written(stage(spark, empty, SF))
        assert empty.count() == 0


def test_repeated_rows_leave_their_text_once(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(200)) for k in "abc"}
    rows_ = [(7, texts["a"], "en", "s", 1)] * 3 + [(None, texts["b"], "en", "s", 1)] * 2 + [(8, texts["c"], "en", "s", 1)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:4]:
        df = written(stage(spark, df, SF))
    assert sorted(r.text for r in df.collect()) == sorted(texts.values())


def test_run_leaves_its_result_only(spark, stages):
    import os
    from urllib.parse import urlparse

    from flagtide.session import ensure_checkpoint_dir

    base = urlparse(ensure_checkpoint_dir(spark)).path
    folders = lambda: {os.path.join(d, x) for d in map(lambda k: os.path.join(base, k), os.listdir(base))
                       if os.path.isdir(d) for x in os.listdir(d)}
    before = folders()
    result = P.run(spark, SF)
    assert len(folders() - before) == 1
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(result) == key(stages[5])
