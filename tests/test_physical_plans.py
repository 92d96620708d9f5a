"""Physical-plan properties the design relies on."""

from pyspark.sql import functions as F

from flagtide.operators import guards as G
from flagtide.operators import rewrite as RW
from flagtide.plans.grounding import quotes_in_texts


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _files(spark):
    rows = [("r1", f"m{i}.py", b"if OLD_FLAG:\n    a()\n") for i in range(20)]
    return spark.createDataFrame([(r, p, len(c), c) for r, p, c in rows],
                                 "repo_id string, path string, size bigint, content binary")


def test_parse_runs_once_per_file(spark):
    plan = _plan(G.extract(_files(spark)).occurrences)
    assert plan.count("ArrowEvalPython") == 1


def test_rewrite_stage_is_hash_partitioned_on_the_file_key(spark):
    files = _files(spark)
    targets = files.select("repo_id", "path", F.lit("OLD_FLAG").alias("flag_name"), F.lit(True).alias("final_state"))
    plan = _plan(RW.rewrite_files(targets, files))
    assert "hashpartitioning(repo_id" in plan and plan.count("ArrowEvalPython") == 1


def test_grounding_has_no_product(spark):
    texts = spark.createDataFrame([(i, f"alpha beta gamma delta {i}") for i in range(50)], "tid int, text string")
    quotes = spark.createDataFrame([(1, "x beta gamma delta y")], "qid int, quote string")
    plan = _plan(quotes_in_texts(quotes, texts, "qid", "quote", "tid", "text"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_parquet_scan_reads_only_needed_columns(spark, tmp_path):
    _files(spark).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    plan = G.path_allowlist(files)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_rewrite_is_dealt_in_many_shares_however_few_splits_hold_the_files(spark):
    files = _files(spark).coalesce(1)
    targets = files.limit(3).select("repo_id", "path", F.lit("OLD_FLAG").alias("flag_name"), F.lit(True).alias("final_state"))
    rewritten = RW.rewrite_files(F.broadcast(targets), files)
    plan = _plan(rewritten)
    shares = RW.SHARES_PER_CORE * spark.sparkContext.defaultParallelism
    below = plan[plan.index("ArrowEvalPython"):]
    assert "hashpartitioning(repo_id" in below and f", {shares}), REPARTITION_BY_NUM" in below
    assert rewritten.where("status = 'mutated'").count() == 3
