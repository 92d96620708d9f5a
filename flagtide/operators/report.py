"""Summaries, report documents and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagtide.plans.validate import MAX_TARGETS
from flagtide.session import materialize

SCHEMA_VERSION = 1


def prep_summary(outcomes: DataFrame, key=("repo_id",)) -> DataFrame:
    """targets / prepared / failed counts."""
    return outcomes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(F.col("status") == "prepared").cast("bigint").alias("prepared"),
        F.count_if(F.col("status") != "prepared").cast("bigint").alias("failed"))


def delivery_summary(deliveries: DataFrame, key=("repo_id",)) -> DataFrame:
    """prep counts plus delivered_or_reused / delivery_failed / not_prepared."""
    s = F.col("delivery_status")
    return deliveries.groupBy(*key).agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(F.col("status") == "prepared").cast("bigint").alias("prepared"),
        F.count_if(s.isin("ready", "delivered", "reused")).cast("bigint").alias("delivered_or_reused"),
        F.count_if(s == "failed").cast("bigint").alias("delivery_failed"),
        F.count_if(s == "not_prepared").cast("bigint").alias("not_prepared"))


def has_failures(outcomes: DataFrame, key=("repo_id",)) -> DataFrame:
    """Any target that is not prepared (or whose delivery failed)."""
    bad = F.col("status") != "prepared"
    if "delivery_status" in outcomes.columns:
        bad = bad | (F.col("delivery_status") == "failed")
    return outcomes.groupBy(*key).agg(F.bool_or(bad).alias("has_failures"))


def prep_records(outcomes: DataFrame, diffs: DataFrame | None = None, key=("repo_id", "flag_name")) -> DataFrame:
    """key and ``record``: flag, state, status, error, validation run, files
    (path and both hashes) and the budgeted diff of every target."""
    key = list(key)
    if diffs is not None:
        o = outcomes.join(diffs.select(*key, "diff"), key, "left")
    else:
        o = outcomes.withColumn("diff", F.lit(None).cast("string"))
    validation = F.when(F.col("validation_passed").isNotNull(), F.struct(
        *(F.col(f"validation_{c}").alias(c) for c in ("output", "passed", "returncode", "timed_out"))))
    record = F.struct(
        F.when(F.col("status") == "prepared", F.col("diff")).alias("diff"),
        F.col("error").alias("error"),
        F.transform("files", lambda f: F.struct(
            f["original_sha256"].alias("original_sha256"), f["path"].alias("path"),
            f["updated_sha256"].alias("updated_sha256"))).alias("files"),
        F.col("final_state").alias("final_state"),
        F.col("flag_name").alias("flag_name"),
        F.col("status").alias("status"),
        validation.alias("validation"))
    return o.select(*key, record.alias("record"))


def delivery_records(deliveries: DataFrame) -> DataFrame:
    """repo_id, flag_name and ``record``: status, error and request per target."""
    request = F.when(F.col("pr_url").isNotNull(), F.struct(
        F.col("branch_name"), F.col("commit_sha"), F.col("pr_number"),
        (F.col("delivery_status") == "reused").alias("reused_existing_pr"), F.col("pr_url").alias("url")))
    return deliveries.select("repo_id", "flag_name", F.struct(
        F.col("delivery_error").alias("error"), F.col("flag_name"), request.alias("pull_request"),
        F.col("delivery_status").alias("status")).alias("record"))


def _parts(records: DataFrame) -> DataFrame:
    """(repo_id, parts) of the repositories with more records than a document
    lists; a part holds half of that on average."""
    return records.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_TARGETS).select(
        "repo_id", F.ceil(2 * F.col("n") / MAX_TARGETS).cast("int").alias("parts"))


def _listed(kinds: dict[str, DataFrame], parts: DataFrame) -> DataFrame:
    """Records of a repository's part, a list for each kind, sorted by flag (null: none).
    Parts are dealt by the flag, so a list stays short whatever the number of records.
    All kinds are gathered in one shuffle."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (
        df.select("repo_id", "flag_name", F.struct("flag_name", "record").alias(name)) for name, df in kinds.items()))
    part = F.coalesce(F.pmod(F.xxhash64("flag_name"), F.col("parts")).cast("int"), F.lit(0))
    lists = rows.join(parts, "repo_id", "left").groupBy("repo_id", part.alias("part")).agg(
        *(F.array_sort(F.collect_list(name)).alias(name) for name in kinds))
    return lists.select("repo_id", "part", *(
        F.when(F.size(name) > 0, F.transform(name, lambda r: r["record"])).alias(name) for name in kinds))


def repo_report(records: DataFrame, summary: DataFrame, mode: str = "dry_run", *, deliveries: DataFrame | None = None,
                baseline: DataFrame | None = None, discovery: DataFrame | None = None, repositories: DataFrame | None = None,
                model: str | None = None, validation_mode: str = "table") -> DataFrame:
    """repo_id, part, parts, report: one JSON document per repository, keys sorted, nulls
    written. A repository with more than ``MAX_TARGETS`` records has several
    documents, alike but for the records they list.

    ``baseline``: repo_id, passed and optionally output, returncode, timed_out;
    ``discovery``: repo_id and a struct ``discovery``; ``repositories``: repo_id,
    host_repository, base_branch (delivery mode); ``deliveries`` come beside the
    preparation records, not instead of them.
    """
    parts = materialize(_parts(records))
    # what a document says but for its records is joined first, by repository alone
    j = summary.join(parts, "repo_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    kinds = {"outcomes": records}
    fields = {"mode": F.lit(mode), "model": F.lit(model).cast("string"), "outcomes": F.col("outcomes"),
              "repository": F.col("repo_id"), "schema_version": F.lit(SCHEMA_VERSION),
              "summary": F.struct(*[F.col(c) for c in sorted(summary.columns) if c != "repo_id"]),
              "validation_mode": F.lit(validation_mode), "baseline_validation": F.lit(None).cast("string"),
              "discovery": F.lit(None).cast("string")}
    if baseline is not None:
        run = F.struct(*((F.col(c) if c in baseline.columns else F.lit(None).cast(t)).alias(c) for c, t in (
            ("output", "string"), ("passed", "boolean"), ("returncode", "int"), ("timed_out", "boolean"))))
        j = j.join(baseline.select("repo_id", run.alias("baseline_validation")), "repo_id", "left")
        fields["baseline_validation"] = F.col("baseline_validation")
    if discovery is not None:
        j = j.join(discovery.select("repo_id", "discovery"), "repo_id", "left")
        fields["discovery"] = F.col("discovery")
    if deliveries is not None:
        kinds["deliveries"] = deliveries
        fields["deliveries"] = F.col("deliveries")
    if repositories is not None:
        j = j.join(repositories.select("repo_id", "host_repository", "base_branch"), "repo_id", "left")
        fields |= {"host_repository": F.col("host_repository"), "base_branch": F.col("base_branch")}
    j = j.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(
        _listed(kinds, parts), ["repo_id", "part"], "left")
    return j.select("repo_id", "part", "parts", F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))),
                                         {"ignoreNullFields": "false"}).alias("report"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Write through Spark's commit protocol (task output is published only
    when the job commits, so a lost executor leaves no partial files)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


OUTBOX_BUCKETS = 64


def write_outbox(files: DataFrame, path: str, run_id: str) -> None:
    """Changed files as an outbox ``path/run_id=.../bucket=...`` that may be written again.

    A run replaces its own buckets only (dynamic partition overwrite), through
    Spark's commit protocol: a run repeated on the same input leaves the same
    files, other runs' parts stay as they are, and a lost executor leaves
    nothing half written. A changed input is another run with an id of its own."""
    bucket = F.pmod(F.xxhash64("repo_id", "path"), F.lit(OUTBOX_BUCKETS)).cast("int")
    dealt = files.withColumns({"run_id": F.lit(run_id), "bucket": bucket}).repartition("bucket", F.pmod(
        F.xxhash64("flag_name", "path"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "bucket").parquet(path)


def read_outbox(spark, path: str, run_id: str) -> DataFrame:
    """The files of one run; only its folders are read."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id", "bucket")


def output_root(spark) -> str:
    """A new folder under the shared checkpoint location, so runs that share
    it do not overwrite each other's sink outputs."""
    import uuid

    from flagtide.session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/outputs/{uuid.uuid4().hex}"

