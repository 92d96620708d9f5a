"""Test-run classification, per-target outcomes, gates and diff budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flagtide.functions import text as tx
from flagtide.session import materialize

# Fixed values.
VALIDATION_TIMEOUT_SECONDS = 300
MAX_DIFF_LINES = 400
MAX_FILES = 200
NOT_PREPARED_TEXT = "Target was not prepared successfully."
NO_CHANGE_PREFIX = "The deterministic transformer made no change in: "
VALIDATION_FAILED = "Post-mutation validation failed."


def classify_runs(runs: DataFrame) -> DataFrame:
    """Raw run records -> ``passed``, ``returncode``, ``timed_out``, ``output``.

    A normal run passes when its code is 0 (a missing code counts as 1). A run
    that crashed or timed out (``error_class`` set) fails with no code; it
    timed out when the class names a timeout or the message says "timed out".
    Output is cut to the report budget.
    """
    crashed = F.col("error_class").isNotNull()
    timed_out = tx.run_timed_out("error_class", "error_message")
    code = F.coalesce(F.col("returncode"), F.lit(1))
    fallback = F.when(timed_out, F.lit(f"Validation timed out after {VALIDATION_TIMEOUT_SECONDS} seconds.")) \
        .otherwise(F.concat(F.lit("Validation execution error: "), F.coalesce("error_message", "error_class")))
    output = F.when(crashed & (F.coalesce(F.col("output"), F.lit("")) == ""), fallback).otherwise(F.col("output"))
    return runs.withColumns({
        "passed": F.when(crashed, F.lit(False)).otherwise(code == 0),
        "returncode": F.when(~crashed, code).cast("int"),
        "timed_out": timed_out,
        "output": tx.truncate_output(output),
    })


def target_outcomes(rewritten: DataFrame, validations: DataFrame | None = None,
                    key=("repo_id", "flag_name"), baseline: DataFrame | None = None) -> DataFrame:
    """Per target: ``preparation_failed`` if any file failed (first error by
    path) or it names more files than a plan may, ``no_changes`` if any file was
    left unchanged (the first ones named), else ``validation_failed`` when its
    post-change run failed, else ``prepared``. Files are listed for prepared
    targets only, after their number has been checked.

    With ``baseline`` (key of the repository, passed), repositories whose
    baseline run failed or is missing have no outcome at all.
    """
    key = list(key)
    if baseline is not None:
        good = baseline.where("passed").select("repo_id").distinct()
        rewritten = rewritten.join(good, "repo_id", "left_semi")
    unchanged = F.when(F.col("status") == "unchanged", F.col("path"))
    judged = [F.min_by(F.struct("path", "error"), F.when(F.col("status") == "failed", F.col("path"))).alias("first_failed"),
              F.count(F.lit(1)).alias("n_files"), F.count(unchanged).alias("n_unchanged"),
              F.first("final_state").alias("final_state")]
    # file bodies stay in the file-change table; outcomes carry keys and hashes
    file = F.struct("path", "original_sha256", "updated_sha256")
    # targets of too many files are counted apart, so that the others are judged and
    # listed in one pass over short groups; rows without a whole key are not listed
    large = materialize(rewritten.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_FILES).select(*key))
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    lists = {"unchanged": F.when(whole, unchanged), "files": F.when(whole & (F.col("status") != "failed"), file)}
    g = rewritten.join(large, key, "left_anti").groupBy(*key).agg(
        *judged, *(F.array_sort(F.collect_list(c)).alias(n) for n, c in lists.items()))
    g = g.withColumns({n: F.when(whole, F.col(n)) for n in lists})
    g = g.unionByName(rewritten.join(large, key, "left_semi").groupBy(*key).agg(*judged), allowMissingColumns=True)
    if validations is not None:
        detail = [F.col(c).alias(f"validation_{c}") if c in validations.columns else F.lit(None).cast(t).alias(f"validation_{c}")
                  for c, t in (("passed", "boolean"), ("output", "string"), ("returncode", "int"), ("timed_out", "boolean"))]
        g = g.join(validations.select(*key, *detail), key, "left")
    else:
        g = g.withColumns({"validation_passed": F.lit(True), "validation_output": F.lit(None).cast("string"),
                           "validation_returncode": F.lit(None).cast("int"), "validation_timed_out": F.lit(None).cast("boolean")})
    status = (F.when(F.col("first_failed.path").isNotNull() | (F.col("n_files") > MAX_FILES), F.lit("preparation_failed"))
              .when(F.col("n_unchanged") > 0, F.lit("no_changes"))
              .when(~F.coalesce(F.col("validation_passed"), F.lit(False)), F.lit("validation_failed"))
              .otherwise(F.lit("prepared")))
    error = (F.when(F.col("first_failed.path").isNotNull(), F.col("first_failed.error"))
             .when(F.col("n_files") > MAX_FILES, F.format_string("%d files; a target may name %d", F.col("n_files"), F.lit(MAX_FILES)))
             .when(status == "no_changes", F.concat(F.lit(NO_CHANGE_PREFIX), F.array_join("unchanged", ", ")))
             .when(status == "validation_failed", F.lit(VALIDATION_FAILED)))
    return g.select(*key, "final_state", status.alias("status"), error.alias("error"),
                    F.when(status == "prepared", F.col("files")).otherwise(
                        F.array().cast(g.schema["files"].dataType)).alias("files"),
                    "validation_passed", "validation_output", "validation_returncode", "validation_timed_out")


def changed_files(rewritten: DataFrame, outcomes: DataFrame, key=("repo_id", "flag_name")) -> DataFrame:
    """What delivery takes over: path and complete new source (as text and as
    bytes) of every file of the prepared targets, one row per file, with the
    hashes before and after."""
    key = list(key)
    prepared = outcomes.where(F.col("status") == "prepared").select(*key)
    return rewritten.where(F.col("status") == "mutated").join(prepared, key, "left_semi").select(
        *key, "path", "updated_source", "updated_bytes", "original_sha256", "updated_sha256")


def baseline_gate(targets: DataFrame, baseline: DataFrame, key: str = "repo_id") -> DataFrame:
    """Repos with no targets run no validation at all; a failing baseline
    stops the repo (nothing processed); otherwise targets go on to be judged
    on their own post-change runs."""
    per_repo = targets.groupBy(key).agg(F.count(F.lit(1)).alias("n_targets"))
    j = per_repo.join(baseline.select(key, F.col("passed").alias("baseline_passed")), key, "left")
    decision = (F.when(F.col("baseline_passed").isNull(), F.lit("baseline_missing"))
                .when(~F.col("baseline_passed"), F.lit("baseline_failed"))
                .otherwise(F.lit("proceed")))
    return j.select(key, "n_targets", decision.alias("decision"))


def diff_budget(diffs: DataFrame, key, max_lines: int = MAX_DIFF_LINES) -> DataFrame:
    """Diff of each target within a line budget.

    Files in path order; after the file at which the running line total
    exceeds ``max_lines`` no more files are read; the first ``max_lines``
    lines are kept and a marker names how many more were seen. ``0`` turns
    diffs off. Windows run per target (bounded by its file count), never
    over a whole repository.
    """
    key = list(key)
    if max_lines == 0:
        return diffs.select(*key).distinct().withColumn("diff", F.lit(None).cast("string"))
    w = Window.partitionBy(*key).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the running total is taken over sizes alone; lines come back for kept files
    sizes = diffs.select(*key, "path", F.size("diff_lines").alias("n"))
    sizes = sizes.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") - F.col("n") <= max_lines)
    kept = diffs.select(*key, "path", "diff_lines").join(sizes.select(*key, "path", "upto"), [*key, "path"])
    g = kept.groupBy(*key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "diff_lines"))),
                              lambda s: s["diff_lines"])).alias("lines"),
        F.max("upto").alias("seen"))
    lines = F.when(F.col("seen") > max_lines, F.concat(
        F.slice("lines", 1, max_lines),
        F.array(F.format_string("... [diff truncated; at least %d additional line(s)]",
                                F.col("seen") - F.lit(max_lines))))).otherwise(F.col("lines"))
    return g.select(*key, F.array_join(lines, "\n").alias("diff"), F.col("seen").cast("bigint").alias("n_lines"))


#: Parts that the paths of a repository are digested in, and folders of a written snapshot.
PATH_BUCKETS, SNAPSHOT_FOLDERS = 64, 256


def snapshot_digests(rows: DataFrame, key=("repo_id", "path")) -> DataFrame:
    """One row per (repository, bucket of paths): number of rows and two sums of
    hashes over path and content hash, whatever the order of the rows.

    The first of ``key`` is the repository. Sums are partial before the shuffle,
    so only digests are shuffled, never rows."""
    repo, *rest = key
    added = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    return rows.groupBy(F.col(repo).alias("repo"), _path_bucket(rest).alias("paths")).agg(
        F.count(F.lit(1)).alias("n"), added(*rest, "sha256").alias("a"), added("sha256", *rest).alias("b"))


def _path_bucket(rest: list[str]) -> F.Column:
    return F.pmod(F.xxhash64(*rest), F.lit(PATH_BUCKETS)).cast("int")


def _differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, paths) of the buckets of the snapshot that are no longer the same."""
    now = after.select(*(F.col(c).alias(f"now_{c}") for c in ("repo", "paths", "n", "a", "b")))
    same_key = F.col("repo").eqNullSafe(F.col("now_repo")) & (F.col("paths") == F.col("now_paths"))
    same = F.col("n").eqNullSafe(F.col("now_n")) & F.col("a").eqNullSafe(F.col("now_a")) & F.col("b").eqNullSafe(F.col("now_b"))
    return before.join(now, same_key, "left").where(~same).select("repo", "paths")


def _stale(snapshots: DataFrame, current: DataFrame, differing: DataFrame, key: list[str]) -> DataFrame:
    """Changed or vanished files among the rows of differing buckets."""
    repo, *rest = key
    inside = lambda df: df.withColumn("__paths", _path_bucket(rest)).join(
        differing, F.col(repo).eqNullSafe(F.col("repo")) & (F.col("__paths") == F.col("paths")), "left_semi").drop("__paths")
    now = inside(current).select(*(F.col(c).alias(f"__now_{c}") for c in key), F.col("sha256").alias("current_sha256"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__now_{c}")) for c in key))
    j = inside(snapshots).join(now, same, "left").select(*snapshots.columns, "current_sha256")
    return j.where(~(F.col("sha256").eqNullSafe(F.col("current_sha256"))))


def stale_snapshots(snapshots: DataFrame, current: DataFrame, key=("repo_id", "path")) -> DataFrame:
    """Files whose content changed (or vanished) between snapshot and apply.

    Both sides are compared by digests of buckets of paths first; rows of files
    meet only in buckets that differ."""
    differing = materialize(_differing(snapshot_digests(snapshots, key), snapshot_digests(current, key)))
    return _stale(snapshots, current, differing, list(key))


def write_snapshot(rows: DataFrame, path: str) -> None:
    """``rows`` (repo_id, path, sha256) as a snapshot that ``stale_since`` reads: rows in
    ``SNAPSHOT_FOLDERS`` folders by repository, and their digests beside them."""
    folder = F.pmod(F.xxhash64("repo_id"), F.lit(SNAPSHOT_FOLDERS)).cast("int")
    rows.select("repo_id", "path", "sha256", folder.alias("folder")).repartition("folder", _path_bucket(["path"])).write.mode(
        "overwrite").partitionBy("folder").parquet(f"{path}/rows")
    spark = rows.sparkSession
    snapshot_digests(spark.read.parquet(f"{path}/rows")).write.mode("overwrite").parquet(f"{path}/digests")


def stale_since(path: str, current: DataFrame) -> DataFrame:
    """``stale_snapshots`` against a written snapshot: its digests decide which of its
    folders are read at all, so what no one touched is not read again."""
    spark = current.sparkSession
    differing = materialize(_differing(spark.read.parquet(f"{path}/digests"), snapshot_digests(current)).withColumn(
        "folder", F.pmod(F.xxhash64("repo"), F.lit(SNAPSHOT_FOLDERS)).cast("int")))
    folders = [r[0] for r in differing.select("folder").distinct().collect()]  # SNAPSHOT_FOLDERS at most
    rows = spark.read.parquet(f"{path}/rows").where(F.col("folder").isin(folders)).select("repo_id", "path", "sha256")
    return _stale(rows, current, differing.select("repo", "paths"), ["repo_id", "path"])
