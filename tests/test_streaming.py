"""The streaming extraction gives the same rows as the batch job."""

from flagtide.operators import guards as G
from flagtide.streaming.incremental import start_incremental_extraction


def test_incremental_matches_batch(spark, tmp_path):
    rows = [("r1", "a.py", b"if OLD_FLAG:\n    a()\n"), ("r1", "b.py", b"x = y if NEW_FLAG else z\n"),
            ("r2", "c.py", b"if:\n")]
    df = spark.createDataFrame([(r, p, len(c), c) for r, p, c in rows],
                               "repo_id string, path string, size bigint, content binary")
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"
    df.coalesce(1).write.parquet(str(src / "batch1"))
    q = start_incremental_extraction(spark, str(src / "batch1"), str(out), str(ckpt), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(out))
    want = G.extract_files(df)
    key = lambda r: (r.repo_id, r.path, r.stage)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    occ = sorted((r.flag_name, r.line) for r in G.extraction_of(got).occurrences.collect())
    assert occ == [("NEW_FLAG", 1), ("OLD_FLAG", 1)]
