"""Statuses, gates, diff budgets and delivery on small tables."""

import json

from pyspark.sql import functions as F

from flagtide.operators import delivery as D
from flagtide.operators import outcomes as O
from flagtide.operators import rewrite as RW


def test_rewrite_job_and_outcomes(spark):
    files = spark.createDataFrame([
        ("r1", "a.py", b"from m import new, old\nif OLD_FLAG:\n    new()\nelse:\n    old()\n"),
        ("r1", "b.py", b"x = 1\n"),
        ("r2", "c.py", b"if OLD_FLAG:\n    new()\n"),
        ("r3", "d.py", b"if:\n"),
    ], "repo_id string, path string, content binary")
    targets = spark.createDataFrame([
        ("r1", "OLD_FLAG", True, "a.py"), ("r1", "OLD_FLAG", True, "b.py"),
        ("r2", "OLD_FLAG", False, "c.py"), ("r3", "OLD_FLAG", True, "d.py"), ("r3", "OLD_FLAG", True, "gone.py"),
    ], "repo_id string, flag_name string, final_state boolean, path string")
    r = RW.rewrite_files(targets, files)
    got = {(x.repo_id, x.path): (x.status, x.updated_source) for x in r.collect()}
    assert got[("r1", "a.py")] == ("mutated", "from m import new\nnew()\n")
    assert got[("r1", "b.py")] == ("unchanged", "x = 1\n")
    assert got[("r2", "c.py")] == ("mutated", "")
    assert got[("r3", "d.py")][0] == "failed" and got[("r3", "gone.py")][0] == "failed"
    runs = spark.createDataFrame([("r1", "OLD_FLAG", True, None), ("r2", "OLD_FLAG", False, "boom"),
                                  ("r3", "OLD_FLAG", True, None)],
                                 "repo_id string, flag_name string, passed boolean, output string")
    o = {x.repo_id: (x.status, x.error) for x in O.target_outcomes(r, runs).collect()}
    assert o["r1"] == ("no_changes", "The deterministic transformer made no change in: b.py")
    assert o["r2"] == ("validation_failed", "Post-mutation validation failed.")
    assert o["r3"][0] == "preparation_failed" and o["r3"][1].startswith("SyntaxError")


def test_diff_budget_truncates(spark):
    diffs = spark.createDataFrame([
        ("r", "F", "a.py", [f"a{i}" for i in range(3)]),
        ("r", "F", "b.py", [f"b{i}" for i in range(4)]),
        ("r", "F", "c.py", [f"c{i}" for i in range(5)]),
    ], "repo_id string, flag_name string, path string, diff_lines array<string>")
    got = O.diff_budget(diffs, ["repo_id", "flag_name"], max_lines=5).collect()[0]
    assert got.diff.split("\n") == ["a0", "a1", "a2", "b0", "b1",
                                    "... [diff truncated; at least 2 additional line(s)]"]
    full = O.diff_budget(diffs, ["repo_id", "flag_name"], max_lines=100).collect()[0]
    assert full.n_lines == 12 and "truncated" not in full.diff


def test_classify_runs(spark):
    runs = spark.createDataFrame([(0, None, None, "ok"), (None, None, None, "x"), (2, "TimeoutExpired", None, ""),
                                  (1, "OSError", "boom", "")],
                                 "returncode int, error_class string, error_message string, output string")
    got = [(r.passed, r.returncode, r.timed_out, r.output) for r in O.classify_runs(runs).collect()]
    assert got == [(True, 0, False, "ok"), (False, 1, False, "x"),
                   (False, None, True, "Validation timed out after 300 seconds."),
                   (False, None, False, "Validation execution error: boom")]


def test_delivery_status(spark):
    outcomes = spark.createDataFrame([
        ("r1", "NEW_UI", "prepared", None, [("a.py",)], "main", "org"),
        ("r1", "OLD_UI", "prepared", None, [("b.py",)], "main", "org"),
        ("r1", "GONE_UI", "prepared", None, [("c.py",)], "main", "org"),
        ("r1", "BAD_UI", "no_changes", "nothing", [], "main", "org"),
        ("r2", "A_B", "prepared", None, [("x.py",)], "main", "org"),
        ("r2", "A__B", "prepared", None, [("y.py",)], "main", "org"),
    ], "repo_id string, flag_name string, status string, error string, files array<struct<path:string>>, "
       "base string, owner string")
    prs = spark.createDataFrame([("r1", "main", "org:remediation/remove-old-ui", "u", 7, "s")],
                                "repo_id string, base string, head string, url string, number int, head_sha string")
    branches = spark.createDataFrame([("r1", "remediation/remove-gone-ui", "t"),
                                      ("r1", "remediation/remove-old-ui", "t2")],
                                     "repo_id string, branch string, sha string")
    got = {r.flag_name: (r.delivery_status, r.commit_sha)
           for r in D.delivery_status(outcomes, prs, branches).collect()}
    assert got == {"NEW_UI": ("ready", None), "OLD_UI": ("reused", "s"), "GONE_UI": ("failed", None),
                   "BAD_UI": ("not_prepared", None), "A_B": ("failed", None), "A__B": ("failed", None)}


def test_bom_and_crlf_survive_the_rewrite(spark):
    files = spark.createDataFrame([("r", "a.py", b"\xef\xbb\xbfif OLD_FLAG:\r\n    a()\r\nb()\r\n")],
                                  "repo_id string, path string, content binary")
    targets = spark.createDataFrame([("r", "OLD_FLAG", True, "a.py")],
                                    "repo_id string, flag_name string, final_state boolean, path string")
    row = RW.rewrite_files(targets, files).collect()[0]
    assert row.status == "mutated" and row.had_bom
    assert bytes(row.updated_bytes) == b"\xef\xbb\xbfa()\r\nb()\r\n"
    import hashlib
    assert row.original_sha256 == hashlib.sha256(b"\xef\xbb\xbfif OLD_FLAG:\r\n    a()\r\nb()\r\n").hexdigest()
    assert row.updated_sha256 == hashlib.sha256(b"\xef\xbb\xbfa()\r\nb()\r\n").hexdigest()


def test_a_file_is_parsed_once_for_all_its_flags(spark, monkeypatch):
    from flagtide.functions import pysource

    text = "from m import a, b\nif A_B:\n    a()\nif C_D:\n    b()\nx = 1 if E_F else 2\n"
    seen = []
    plain = pysource._parse
    monkeypatch.setattr(pysource, "_parse", lambda t: seen.append(t) or plain(t))
    asked = [("A_B", True), ("C_D", False), ("E_F", True), ("A_B", False), ("G_H", True)]
    each = pysource.rewrite_each(text, asked)
    assert seen.count(text) == 1
    assert each == [pysource.rewrite_source(text, f, s) for f, s in asked]  # independent of each other


def test_targets_of_one_file_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(RW, "FLAGS_AT_ONCE", 3)
    flags = [f"F_{i}" for i in range(10)]
    body = "".join(f"if {f}:\n    f{i}()\n" for i, f in enumerate(flags)).encode()
    files = spark.createDataFrame([("r", "a.py", body), ("r", "bad.py", b"\xff\xfe"), ("r", "other.py", b"x")],
                                  "repo_id string, path string, content binary")
    asked = [("r", f, i % 2 == 0, "a.py") for i, f in enumerate(flags)] + [
        ("r", "F_0", True, "a.py"), ("r", None, True, "a.py"), ("r", "F_1", True, "bad.py"), ("r", "F_2", True, "gone.py")]
    targets = spark.createDataFrame(asked, "repo_id string, flag_name string, final_state boolean, path string")
    got = RW.rewrite_files(targets, files).collect()
    assert len(got) == len(asked)
    for r in got:
        if r.path == "a.py" and r.flag_name:
            i = int(r.flag_name[2:])
            lines = [f"f{j}()\n" if j == i else f"if F_{j}:\n    f{j}()\n" for j in range(10) if j != i or i % 2 == 0]
            assert r.status == "mutated" and r.updated_source == "".join(lines)
    errors = {r.path: (r.status, r.error) for r in got if r.path != "a.py"}
    assert errors == {"bad.py": ("failed", "invalid UTF-8"), "gone.py": ("failed", "file not found: gone.py")}


def _veto_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_veto_stops_its_group_only(spark, tmp_path):
    rows = [(i // 3, i, i == 7 or None) for i in range(3000)] + [(None, 1, False), (None, 2, True), (5000, 3, None)]
    spark.createDataFrame(rows, "g int, n int, bad boolean").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    gated = RW.gate_all_or_nothing(df, ["g"], F.col("bad"))
    got = {(r.g, r.n): r.group_failed for r in gated.collect()}
    assert got == {(g, n): g in (2, None) for g, n, _ in rows}
    # no row is shuffled: the only exchange is that of the bitmap's pages
    assert all("_groupingexpression" in x for x in _veto_plan(gated).split("\n") if "Exchange hashpartitioning" in x)


def test_many_vetoes_are_joined_by_key(spark, tmp_path, monkeypatch):
    from flagtide.operators import keys

    monkeypatch.setattr(keys, "MOST_BITS", 4)  # the bitmap tells nothing apart any more
    monkeypatch.setattr(keys, "LEAST_BITS", 4)
    df = spark.range(4000).selectExpr("id % 500 as g", "id", "id % 500 < 400 and id < 500 as bad")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gated = RW.gate_all_or_nothing(df, ["g"], F.col("bad"))
        assert gated.where("group_failed != (g < 400)").count() == 0 and gated.count() == 4000
        assert "SortMergeJoin" in _veto_plan(gated)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _hashes(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, path string, sha256 string")


def test_stale_snapshots_read_differing_buckets_only(spark, tmp_path):
    before = [(f"r{r}", f"d/{i}.py", f"h{r}.{i}") for r in range(30) for i in range(200)] + [("n", "x.py", None), (None, "y.py", "q")]
    gone, changed = ("r3", "d/7.py"), ("r9", "d/11.py")
    after = [(r, p, "new" if (r, p) == changed else h) for r, p, h in before if (r, p) != gone] + [("r1", "d/new.py", "z")]
    want = {(*gone, "h3.7", None), (*changed, "h9.11", "new")}
    assert {tuple(r) for r in O.stale_snapshots(_hashes(spark, before), _hashes(spark, after)).collect()} == want
    path = str(tmp_path / "snapshot")
    O.write_snapshot(_hashes(spark, before), path)
    since = O.stale_since(path, _hashes(spark, after))
    assert {tuple(r) for r in since.collect()} == want
    assert "PartitionFilters: [folder" in since._jdf.queryExecution().executedPlan().toString()
    assert O.stale_since(path, _hashes(spark, before)).count() == 0


def test_digests_see_rows_not_their_order(spark):
    rows = [("r", f"{i}.py", f"h{i}") for i in range(50)]
    a, b = (O.snapshot_digests(_hashes(spark, x)) for x in (rows, rows[::-1]))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    swapped = [("r", "0.py", "h1"), ("r", "1.py", "h0"), *rows[2:]]
    assert sorted(map(tuple, O.snapshot_digests(_hashes(spark, swapped)).collect())) != sorted(map(tuple, a.collect()))


def test_outbox_may_be_written_again(spark, tmp_path):
    from flagtide.operators import report as R

    out = str(tmp_path / "outbox")
    rows = spark.createDataFrame([("r", "A_B", f"{i}.py", f"s{i}", b"x", "o", "u") for i in range(100)],
                                 "repo_id string, flag_name string, path string, updated_source string, updated_bytes binary, "
                                 "original_sha256 string, updated_sha256 string")
    R.write_outbox(rows, out, "one")
    R.write_outbox(rows.limit(10), out, "two")
    R.write_outbox(rows, out, "one")
    assert sorted(map(tuple, R.read_outbox(spark, out, "one").select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert R.read_outbox(spark, out, "two").count() == 10


def test_a_long_report_comes_in_parts(spark):
    from flagtide.operators import report as R

    flags = [("big", f"F_{i}") for i in range(1_000)] + [("small", "A_B"), ("small", "C_D")]
    records = spark.createDataFrame(flags, "repo_id string, flag_name string").withColumn("record", F.struct("flag_name"))
    summary = records.groupBy("repo_id").agg(F.count(F.lit(1)).alias("targets"))
    got = R.repo_report(records, summary).collect()
    listed = {}
    for r in got:
        names = [x["flag_name"] for x in json.loads(r.report)["outcomes"]]
        assert names == sorted(names) and len(names) <= 100
        listed.setdefault(r.repo_id, []).extend(names)
    assert {k: sorted(v) for k, v in listed.items()} == {"big": sorted(f for r, f in flags if r == "big"), "small": ["A_B", "C_D"]}
    assert sum(r.repo_id == "small" for r in got) == 1 and {r.parts for r in got if r.repo_id == "big"} == {20}


def _outcomes(spark):
    return spark.createDataFrame(
        [("r", "A_B", "prepared", None, "o", "main", [("a.py", "1", "2")]), ("r", "C_D", "prepared", None, "o", "main", []),
         ("s", "A_B", "no_changes", "none", "o", "main", [])],
        "repo_id string, flag_name string, status string, error string, owner string, base string, "
        "files array<struct<path:string,original_sha256:string,updated_sha256:string>>")


def test_statuses_do_not_carry_files_through_joins(spark):
    from flagtide.operators import report as R

    prs = spark.createDataFrame([], "repo_id string, base string, head string, url string, number int, head_sha string")
    branches = spark.createDataFrame([], "repo_id string, branch string, sha string")
    d = D.delivery_status(_outcomes(spark), prs, branches)
    assert set(_outcomes(spark).columns) < set(d.columns) and "n_files" not in d.columns
    assert {(r.flag_name, r.repo_id): r.delivery_status for r in d.collect()} == {
        ("A_B", "r"): "ready", ("C_D", "r"): "failed", ("A_B", "s"): "not_prepared"}
    plan = R.delivery_summary(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(files" in plan and plan.index("size(files") > plan.index("Window")


def test_branch_names_of_plain_and_odd_flags(spark):
    from flagtide.functions import text as tx

    long = "A_" + "B" * 90
    names = ["A_B", "A1_B2_C", "A__B", " A_B\t", "_A_", "__", "É_A", "a_b", "A_B\n", "A" * 78 + "_B", "A" * 79 + "_B", long, None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "f string").select(tx.branch_name("f")).collect()]
    p = "remediation/remove-"
    assert got == [p + s if s else None for s in (
        "a-b", "a1-b2-c", "a-b", "a-b", "a", None, "a", "a-b", "a-b", "a" * 78 + "-b", "a" * 79, ("a-" + "b" * 90)[:80], None)]


def test_outcomes_of_large_targets_and_of_rows_without_a_key(spark):
    few = [("r", "A_B", True, f"m{i}.py", "mutated", None, f"o{i}", f"u{i}") for i in (2, 0, 1)]
    many = [("r", "C_D", False, f"m{i:03}.py", "mutated", None, "o", "u") for i in range(O.MAX_FILES + 1)]
    odd = [(None, "A_B", True, "x.py", "unchanged", None, "o", "u"), (None, "C_D", True, "y.py", "failed", "E: y", None, None)]
    rows = spark.createDataFrame(few + many + odd, "repo_id string, flag_name string, final_state boolean, path string, "
                                 "status string, error string, original_sha256 string, updated_sha256 string")
    got = {(r.repo_id, r.flag_name): r for r in O.target_outcomes(rows).collect()}
    assert len(got) == 4
    assert got["r", "A_B"].status == "prepared" and [f.path for f in got["r", "A_B"].files] == ["m0.py", "m1.py", "m2.py"]
    big = got["r", "C_D"]
    assert (big.status, big.error, big.files) == ("preparation_failed", "201 files; a target may name 200", [])
    assert (got[None, "A_B"].status, got[None, "A_B"].error, got[None, "A_B"].files) == ("no_changes", None, [])
    assert (got[None, "C_D"].status, got[None, "C_D"].error) == ("preparation_failed", "E: y")


def test_report_gathers_all_records_at_once(spark):
    from flagtide.operators import report as R

    records = spark.createDataFrame([("r", "B_B"), ("r", "A_B"), ("s", "A_B")], "repo_id string, flag_name string").withColumn(
        "record", F.struct("flag_name"))
    done = records.where("repo_id = 'r'").withColumn("record", F.struct("flag_name", F.lit("ready").alias("status")))
    summary = spark.createDataFrame([("r", 2), ("s", 1), ("t", 0)], "repo_id string, targets int")
    reports = R.repo_report(records, summary, deliveries=done)
    got = {r.repo_id: json.loads(r.report) for r in reports.collect()}
    assert [x["flag_name"] for x in got["r"]["outcomes"]] == [x["flag_name"] for x in got["r"]["deliveries"]] == ["A_B", "B_B"]
    assert got["s"]["deliveries"] is None and len(got["s"]["outcomes"]) == 1
    assert got["t"]["deliveries"] is None and got["t"]["outcomes"] is None
    plan = reports._jdf.queryExecution().optimizedPlan().toString()
    assert sum("collect_list" in line for line in plan.split("\n") if "Aggregate" in line) == 1
