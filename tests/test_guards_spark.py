"""Extraction, grouping, limits and gates as Spark jobs on inline file tables."""

import pytest
from pyspark.sql import functions as F

from flagtide.operators import guards as G

SCHEMA = "repo_id string, path string, size bigint, content binary"


def files_df(spark, rows):
    return spark.createDataFrame(
        [(r, p, len(s.encode() if isinstance(s, str) else s), s.encode() if isinstance(s, str) else s)
         for r, p, s in rows], SCHEMA)


def test_statements_and_ternaries_of_one_switch_are_one_candidate(spark):
    files = files_df(spark, [
        ("shop", "cart/totals.py", "def total(c):\n    if USE_TAX_V2:\n        return tax(c)\n    return c.sum\n"),
        ("shop", "cart/__init__.py", "rate = (0.2 if USE_TAX_V2 else 0.19)\n"),
        ("blog", "feed.py", "if verbose:\n    log()\nif settings['USE_TAX_V2']:\n    log()\nif not USE_TAX_V2:\n    log()\n"),
    ])
    cands, errors = G.discover_candidates(files)
    assert errors.count() == 0
    (c,) = cands.collect()
    assert (c.repo_id, c.flag_name, c.n_occurrences) == ("shop", "USE_TAX_V2", 2)
    assert [(o.file_path, o.line, o.kind) for o in c.occurrences] == [
        ("cart/__init__.py", 1, "ternary_expression"), ("cart/totals.py", 2, "if_statement")]
    assert c.occurrences[1].snippet.split("\n")[1] == "   2:     if USE_TAX_V2:"


def test_syntax_error_fails_the_repo_not_the_job(spark):
    files = files_df(spark, [
        ("r1", "ok.py", "if NEW_FLAG:\n    a()\n"),
        ("r1", "bad.py", "if:\n"),
        ("r2", "ok.py", "if NEW_FLAG:\n    a()\n"),
    ])
    cands, errors = G.discover_candidates(files)
    assert [r.repo_id for r in cands.collect()] == ["r2"]
    err = errors.collect()
    assert [(e.repo_id, e.path, e.stage) for e in err] == [("r1", "bad.py", "parse")]


def test_oversize_and_undecodable_files(spark):
    files = files_df(spark, [
        ("r1", "big.py", "x = 1\n" * 10),
        ("r2", "bin.py", b"\xff\xfe"),
        ("r3", "bom.py", b"\xef\xbb\xbfif NEW_FLAG:\n    a()\n"),
    ])
    per_file = G.extract_files(files, max_file_bytes=50)
    got = {(r.repo_id, r.stage) for r in per_file.collect()}
    assert got == {("r1", "oversize"), ("r2", "decode"), ("r3", None)}
    occ = G.extraction_of(per_file).occurrences.collect()
    assert [(o.flag_name, o.line) for o in occ] == [("NEW_FLAG", 1)]


def test_occurrence_limit_drops_group_before_collecting(spark):
    body = "".join(f"if MANY_FLAG:\n    a{i}()\n" for i in range(4))
    files = files_df(spark, [("r1", "a.py", body), ("r1", "b.py", "if FEW_FLAG:\n    b()\n")])
    occ = G.extract(files).occurrences
    over = G.occurrence_limit(occ, 3).collect()
    assert [(r.flag_name, r.n_occurrences) for r in over] == [("MANY_FLAG", 4)]
    grouped = G.group_candidates(occ, 3)
    assert [r.flag_name for r in grouped.rows.collect()] == ["FEW_FLAG"]
    assert [(r.flag_name, r.n_occurrences) for r in grouped.over_limit.collect()] == [("MANY_FLAG", 4)]
    cands, errors = G.discover_candidates(files, limit=3)
    assert cands.count() == 0
    assert [r.stage for r in errors.collect()] == ["occurrence_limit"]


def test_prune_ignored_keeps_dunder_init_and_hidden_files(spark):
    paths = ["__init__.py", "pkg/__init__.py", ".hidden.py", "tests/t.py", "a/.git/x.py",
             "a/node_modules/m.py", "a/b/c.py", "x.PY", "testsuite/y.py", "a/__pycache__/z.py"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    kept = sorted(r.path for r in G.prune_ignored(df).collect())
    assert kept == [".hidden.py", "__init__.py", "a/b/c.py", "pkg/__init__.py", "testsuite/y.py"]


def test_decode_and_encode_round_trip(spark):
    df = spark.createDataFrame([(b"\xef\xbb\xbfx = 1\r\n",), (b"y\n",)], "content binary")
    d = G.decode_source(df)
    rows = d.select("had_bom", "text", (G.encode_source("text", "had_bom") == F.col("content")).alias("same")).collect()
    assert [(r.had_bom, r.text, r.same) for r in rows] == [(True, "x = 1\r\n", True), (False, "y\n", True)]


def test_tree_data_source(spark, tmp_path):
    from flagtide.sources import tree

    layout = {
        "r1/__init__.py": b"", "r1/app.py": b"if OLD_FLAG:\n    a()\n", "r1/.hidden.py": b"x = 1\n",
        "r1/tests/t.py": b"", "r1/.git/x.py": b"", "r1/pkg/sub/m.py": b"y = 2\n", "r1/pkg/M.PY": b"",
        "r1/pkg/node_modules/n.py": b"", "r1/pkg/notes.txt": b"", "r2/lib/dist/d.py": b"", "r2/lib/l.py": b"z\n",
    }
    for rel, data in layout.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    df = tree.read_tree(spark, f"file:{tmp_path}", max_file_bytes=20)
    got = sorted((r.repo_id, r.path, r.size, r.content) for r in df.collect())
    assert got == [("r1", ".hidden.py", 6, b"x = 1\n"), ("r1", "__init__.py", 0, b""), ("r1", "app.py", 21, None),
                   ("r1", "pkg/sub/m.py", 6, b"y = 2\n"), ("r2", "lib/l.py", 2, b"z\n")]
    stages = {r.path: r.stage for r in G.extract_files(df, max_file_bytes=20).collect()}
    assert stages["app.py"] == "oversize" and stages["lib/l.py"] is None


def _layout(tmp_path, files):
    for rel, data in files.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def _plain_tree(root):
    """Every kept file by a plain walk."""
    out = {}
    for repo in (p for p in root.iterdir() if p.is_dir()):
        for p in repo.rglob("*"):
            parts = p.relative_to(repo).parts
            if p.is_file() and p.name.endswith(".py") and not any(d in G.IGNORED_DIRS or d.startswith(".") for d in parts[:-1]):
                out[repo.name, "/".join(parts)] = p.read_bytes()
    return out


@pytest.mark.parametrize("entries, planned", [(100_000, 200_000), (100, 200_000), (100_000, 3), (7, 1)])
def test_tree_units_hold_every_file_once(spark, tmp_path, monkeypatch, entries, planned):
    """A flat folder beyond what one task goes through, deep folders, and a root of many
    repositories, with planning that sees all of it, a part, or nearly nothing."""
    from flagtide.sources import tree

    files = {f"flat/m{i}.py": b"x" * (i % 50) for i in range(400)}
    files |= {f"r{i}/a/b{i % 3}/c.py": str(i).encode() for i in range(60)} | {f"r{i}/.git/x.py": b"" for i in range(5)}
    files |= {"deep/" + "/".join("d" * n for n in range(1, 12)) + "/z.py": b"z", "loose.py": b"", ".cfg/k.py": b"k"}
    _layout(tmp_path, files)
    monkeypatch.setattr(tree, "FOLDER_ENTRIES", entries)
    want = _plain_tree(tmp_path)
    parts = tree.plan(str(tmp_path), frozenset(G.IGNORED_DIRS), lambda x: True, planned, 1 << 16, 10 ** 6)
    reader = tree.TreeReader({"path": str(tmp_path)})
    got = [(r, p) for part in parts for b in reader.read(part) for r, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(got) == sorted(want)
    flat = [p for p in parts if p.unit and p.unit.folder == "flat"]
    assert (len(flat) == tree.SLICES) == (entries == 100)
    if planned == 200_000 and entries > 400:
        assert all(sum(4096 + f.size for f in p.files) <= 1 << 16 for p in parts) and len(parts) > 10


def test_tree_format(spark, tmp_path):
    from flagtide.sources import tree

    _layout(tmp_path, {f"r{i % 5}/p{i}.py": b"y" * i for i in range(90)} | {"r1/big.py": b"0" * 500})
    tree.register(spark)
    df = spark.read.format(tree.FORMAT).option("maxFileBytes", 100).option("partBytes", 40_000).load(f"file:{tmp_path}")
    rows = {(r.repo_id, r.path): (r.size, r.content) for r in df.collect()}
    want = _plain_tree(tmp_path)
    assert {k: v[1] for k, v in rows.items()} == {k: v if len(v) <= 100 else None for k, v in want.items()}
    assert rows["r1", "big.py"] == (500, None) and df.rdd.getNumPartitions() > 5
    some = df.where((F.col("repo_id") == "r1") & F.col("path").endswith("6.py") & (F.col("size") <= 60))
    assert {(r.repo_id, r.path) for r in some.collect()} == {k for k, v in want.items() if k[0] == "r1" and k[1].endswith("6.py") and len(v) <= 60}
    reader = tree.TreeReader({"path": str(tmp_path)})
    pushed = [tree.StringEndsWith(("path",), "6.py"), tree.LessThanOrEqual(("size",), 60), tree.EqualTo(("read_error",), "x")]
    assert list(reader.pushFilters(pushed)) == pushed and len(reader.filters) == 2
    assert sum(len(p.files) for p in reader.partitions()) == sum(k[1].endswith("6.py") and len(v) <= 60 for k, v in want.items())


def test_listing_rounds(spark, tmp_path, monkeypatch):
    from flagtide.sources import tree

    _layout(tmp_path, {f"r{i}/a{i % 7}/b/m{j}.py": b"q" for i in range(12) for j in range(9)})
    for name, value in (("FIRST_WALK", 1), ("WALK", 10), ("FOLDER_ENTRIES", 8)):
        monkeypatch.setattr(tree, name, value)
    got = [(r.repo_id, r.path) for r in tree.list_tree(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(_plain_tree(tmp_path))
    (tmp_path / "empty").mkdir()
    assert tree.list_tree(spark, str(tmp_path / "empty")).count() == 0


def test_tree_rows_for_what_cannot_be_read(spark, tmp_path):
    from flagtide.sources import tree

    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "gone.py").write_text("x = 1\n")
    listed = tree.list_tree(spark, str(tmp_path))
    assert listed.count() == 1
    read = tree.read_tree(spark, str(tmp_path))
    (tmp_path / "r1" / "gone.py").unlink()
    row = read.collect()[0]
    assert row.content is None and row.read_error.startswith("FileNotFoundError")
    assert [(r.stage, r.error) for r in G.extract_files(read).collect()] == [("read", row.read_error)]
    cands, errors = G.discover_candidates(read.unionByName(files_df(spark, [("r1", "a.py", "if A_B:\n    c()\n"), (
        "r2", "a.py", "if A_B:\n    c()\n")]).withColumn("read_error", F.lit(None).cast("string"))))
    assert [r.repo_id for r in cands.collect()] == ["r2"]  # a file that cannot be read ends its repository's candidates
    assert [(e.path, e.error) for e in errors.collect()] == [("gone.py", row.read_error)]
    with pytest.raises(ValueError):
        tree.mounted_path("hdfs://host/tree")


def test_path_spellings_are_one_row(spark):
    df = spark.createDataFrame([("r", "a/b.py"), ("r", " a\\b.py "), ("r", "a/b.py"), ("r", "/abs.py")], "repo_id string, path string")
    got = sorted((r.path or "", r.raw_path) for r in G.path_allowlist(df).collect())
    assert got == [("", "/abs.py"), ("a/b.py", None)]


def test_top_flags_counts_repos_with_a_broken_file(spark):
    files = files_df(spark, [("r1", "ok.py", "if NEW_FLAG:\n    a()\n"), ("r1", "bad.py", "if:\n"),
                             ("r2", "ok.py", "if NEW_FLAG:\n    a()\n")])
    rows = G.top_flags(G.extract(files).occurrences).collect()
    assert [tuple(r) for r in rows] == [("NEW_FLAG", 2, 2, 2)]


def test_gate_flags_whole_groups(spark):
    from flagtide.operators import rewrite as RW

    rows = spark.createDataFrame([(i % 3, i, i == 4) for i in range(300)], "g int, i int, bad boolean")
    got = RW.gate_all_or_nothing(rows, ["g"], F.col("bad")).collect()
    assert len(got) == 300 and all(r.group_failed == (r.g == 1) for r in got)


def test_folders_left_by_the_planning_share_partitions(tmp_path):
    from flagtide.sources import tree

    for i in range(2 * tree.LEFT_PARTS):
        (tmp_path / f"r{i}").mkdir()
    (tmp_path / "r1/a.py").write_bytes(b"x")
    parts = tree.plan(str(tmp_path), frozenset(), lambda x: True, 1, 1 << 16, 10 ** 6)
    assert len(parts) == tree.LEFT_PARTS and sum(len(p.units) for p in parts) == 2 * tree.LEFT_PARTS


def test_trees_one_after_another(spark, tmp_path):
    """A table in several trees: no tree has all of it, none is left, all rows are read."""
    from pathlib import Path

    from flagtide.sources import tree

    files = {(f"r{i % 9}", f"p{i % 3}/m{i}.py"): b"y" * i for i in range(200)}
    df = spark.createDataFrame([(*k, len(v), bytearray(v)) for k, v in files.items()],
                               "repo_id string, path string, size long, content binary")
    seen = []

    def read(root):
        seen.append(len(_plain_tree(Path(root))))
        return tree.read_tree(spark, root)

    for limit, trees in ((50, 4), (1000, 1)):
        seen.clear()
        got = tree.through_trees(df, f"{tmp_path}/trees", read, limit)
        rows = {(r.repo_id, r.path): bytes(r.content) for r in got.collect()}
        assert rows == files and got.count() == len(files)
        assert len(seen) <= trees and sum(seen) == len(files) and not list((tmp_path / "trees").iterdir())
    assert tree.through_trees(df.limit(0), f"{tmp_path}/none", lambda root: tree.read_tree(spark, root)).count() == 0


def _source_files(spark, files):
    return spark.createDataFrame([(*k, len(v), bytearray(v)) for k, v in files.items()],
                                 "repo_id string, path string, size long, content binary")


def test_next_tree_is_written_over_the_one_before(spark, tmp_path):
    """Files and folders of a tree that was read become those of the next one, whole and
    under their new names only; a file with two names is not written through both."""
    import os

    from flagtide.sources import tree

    old = {(f"r{i % 7}", f"p{i % 3}/a/m{i}.py"): b"y" * (i % 90) for i in range(300)}
    new = {(f"s{i % 5}", f"q{i % 4}/n{i}.py"): f"{i}".encode() * (i % 40) for i in range(250)}
    tree.write_tree(_source_files(spark, old), f"{tmp_path}/0").collect()
    there = {p.stat().st_ino for p in (tmp_path / "0").rglob("*")}
    for i in range(6, 300, 7):
        os.link(tmp_path / f"0/r6/p{i % 3}/a/m{i}.py", tmp_path / f"0/r5/twice{i}.py")
    for again in (False, True):  # again, as after an attempt that failed late
        rows = tree.write_tree(_source_files(spark, new).repartition(4, "repo_id"), f"{tmp_path}/1", (f"{tmp_path}/0",)).collect()
        assert sum(r.written for r in rows) == 250 and _plain_tree(tmp_path / "1") == new
        assert all(p.stat().st_nlink == 1 for p in (tmp_path / "1").rglob("*.py"))
        if not again:
            taken = sum(r.taken for r in rows)
            assert taken > 125 and sum(p.stat().st_ino in there for p in (tmp_path / "1").rglob("*.py")) >= taken
            assert any(p.stat().st_ino in there for p in (tmp_path / "1").rglob("q*"))


@pytest.mark.parametrize("repos, lanes", [(1, 1), (1, 2), (40, 2), (200, 3)])
def test_trees_over_each_other_hold_their_own_rows(spark, tmp_path, monkeypatch, repos, lanes):
    """Pieces of one repository or of many, repeated rows, lanes side by side: every tree
    has its own files and no other, and in all no more than some trees are on disk."""
    from pathlib import Path

    from flagtide.sources import tree

    monkeypatch.setattr(tree, "LANES", lanes)
    files = {(f"r{i % repos}", f"p{i % 3}/m{i}.py"): f"x = {i}\n".encode() * (1 + i % 5) for i in range(200)}
    df, most, seen = _source_files(spark, files), [], []

    def read(root):
        seen.append(_plain_tree(Path(root)))
        most.append(sum(1 for _ in tmp_path.rglob("*.py")))
        return tree.read_tree(spark, root)

    got = tree.through_trees(df.union(df), f"{tmp_path}/trees", read, 40)
    rows = [((r.repo_id, r.path), bytes(r.content)) for r in got.collect()]
    assert sorted(rows) == sorted(files.items()) and len(seen) > 3
    assert sum(len(t) for t in seen) == 200 and {k: v for t in seen for k, v in t.items()} == files
    assert max(most) <= lanes * 3 * 40 and not list((tmp_path / "trees").iterdir())


def test_failing_read_ends_the_trees(spark, tmp_path):
    from flagtide.sources import tree

    files = {(f"r{i % 9}", f"m{i}.py"): b"y" for i in range(200)}
    begun = []

    def read(root):
        begun.append(root)
        raise OSError("no")

    with pytest.raises(OSError):
        tree.through_trees(_source_files(spark, files), f"{tmp_path}/trees", read, 10)
    assert len(begun) <= tree.LANES


def test_snippets_are_cut_once(spark):
    """Counting guards needs no snippets, and the filter on empty lists none either."""
    files = spark.createDataFrame([("r", "a.py", 9, bytearray(b"if A_B:\n    x()\n"))],
                                  "repo_id string, path string, size long, content binary")
    occ = G.extract(files).occurrences
    plan = occ._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "array_join" in line]
    assert [tuple(r) for r in occ.collect()] == [("r", "A_B", "a.py", 1, "if_statement", "   1: if A_B:\n   2:     x()")]
