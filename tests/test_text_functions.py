"""Native Column helpers against plain Python semantics."""

import pytest
from pyspark.sql import functions as F

from flagtide.functions import text as tx

BAD_PATHS = ["   ", "/srv/main.py", "D:/work/main.py", "lib/../../main.py", "..", "lib/./main.py", "lib//main.py",
             "lib/main.txt", "lib/"]


def _one(spark, col_fn, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_strip_matches_python(spark):
    values = [" a ", "\t\nb\x0b\x0c", "\u3000c\u00a0", "\x1cd\x1f", "e\u2028", "  ", "x y"]
    assert _one(spark, tx.strip_ws, values) == [v.strip() for v in values]


def test_unsafe_paths_rejected(spark):
    got = _one(spark, lambda c: tx.normalize_path(c)["error_code"], BAD_PATHS)
    assert all(code is not None for code in got)


def test_good_path_normalised(spark):
    got = _one(spark, lambda c: tx.normalize_path(c)["path"], [" lib\\net\\dns.py ", "a/.py", "a/b.PY"])
    assert got == ["lib/net/dns.py", None, "a/b.PY"]
    model = _one(spark, lambda c: tx.normalize_path(c, model=True)["path"], ["a/.py"])
    assert model == ["a/.py"]


def test_branch_name(spark):
    got = _one(spark, tx.branch_name, ["ENABLE_NEW_UI", "  A__B  ", "***", "X" * 100])
    assert got == ["remediation/remove-enable-new-ui", "remediation/remove-a-b", None,
                   "remediation/remove-" + "x" * 80]


def _py_truncate_snippet(s, limit=2000, marker="\n... [snippet truncated]"):
    if len(s) <= limit:
        return s
    return s[:max(0, limit - len(marker))].rstrip() + marker


@pytest.mark.parametrize("n", [10, 1999, 2000, 2001, 5000])
def test_truncate_snippet(spark, n):
    s = ("word " * n)[:n]
    assert _one(spark, tx.truncate_snippet, [s]) == [_py_truncate_snippet(s)]


def test_truncate_output(spark):
    s = "y" * 50010
    got = _one(spark, tx.truncate_output, [s, "short"])
    assert got == ["y" * 50000 + "\n... [truncated 10 character(s)]", "short"]


def test_is_flag_name(spark):
    values = ["ENABLE_NEW_UI", "DEBUG", "enable_x", "A_1", "_A_B", "A_", "A_B\n"]
    assert _one(spark, tx.is_flag_name, values) == [True, False, False, True, False, False, False]


def test_guard_snippet(spark):
    df = spark.createDataFrame([("l1\nl2\nl3\nl4\nl5\nl6\n",)], "t string")
    lines = tx.split_lines(F.col("t"))
    got = df.select(tx.guard_snippet(lines, F.lit(2), F.lit(3))).collect()[0][0]
    assert got == "   1: l1\n   2: l2\n   3: l3\n   4: l4\n   5: l5"
