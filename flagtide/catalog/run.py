"""The end-to-end query: accepted plans through rewrite, gates and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from flagtide.catalog.extract import _candidates, _files
from flagtide.catalog.plans import _FIRSTS_SQL, _allowlist, contexts, plan_attempts
from flagtide.catalog.rewrite import DELIVERY_FEEDS, _baseline, validation_runs
from flagtide.plans.run import remediation_run as run_all
from flagtide.registry import query
from flagtide.sources.tables import CORPUS_SQL, shared_sql

# Accepted plans hold candidates only, so every file of theirs is changed by the
# rewrite; the validation run then decides, and the delivery feeds after it.
_RUN_SQL = _FIRSTS_SQL + ", " + DELIVERY_FEEDS + """
, att AS (
  SELECT repo_id, 1 AS attempt,
         CASE WHEN CAST(repo_id AS BIGINT) % 31 = 0 THEN 'fatal'
              WHEN repo_id IN (SELECT repo_id FROM firsts) THEN 'invalid' ELSE 'valid' END AS outcome
  FROM (SELECT DISTINCT repo_id FROM proposal) p
  UNION ALL SELECT DISTINCT repo_id, 2, 'valid' FROM cand WHERE CAST(repo_id AS BIGINT) % 3 = 0
),
stop AS (SELECT repo_id, min(attempt) AS attempt FROM att WHERE outcome IN ('valid', 'fatal') GROUP BY repo_id),
acc AS (SELECT s.repo_id, s.attempt FROM stop s JOIN att a ON a.repo_id = s.repo_id AND a.attempt = s.attempt WHERE a.outcome = 'valid'),
plan AS (SELECT t.repo_id, t.flag_name FROM tgt t JOIN acc a ON a.repo_id = t.repo_id AND a.attempt = 1
         UNION ALL SELECT t.repo_id, t.flag_name FROM tgt2 t JOIN acc a ON a.repo_id = t.repo_id AND a.attempt = 2),
res AS (
  SELECT p.repo_id, p.flag_name, (CAST(p.repo_id AS BIGINT) + length(p.flag_name)) % 2 = 0 AS final_state,
         CASE WHEN (CAST(p.repo_id AS BIGINT) + length(p.flag_name)) % 4 <> 0 THEN 'prepared' ELSE 'validation_failed' END AS status,
         (SELECT CAST(count(*) AS BIGINT) FROM cand_files c WHERE c.repo_id = p.repo_id AND c.flag_name = p.flag_name) AS n_files,
         concat('remediation/remove-', replace(lower(p.flag_name), '_', '-')) AS branch
  FROM plan p WHERE CAST(p.repo_id AS BIGINT) % 6 <> 0
)
SELECT r.repo_id, r.flag_name, r.final_state, r.status, CASE WHEN r.status = 'prepared' THEN n_files ELSE 0 END AS n_files,
       CASE WHEN r.status <> 'prepared' THEN 'not_prepared'
            WHEN CAST(r.repo_id AS BIGINT) % 17 = 0 THEN 'failed'
            WHEN CAST(r.repo_id AS BIGINT) % 13 = 0 THEN 'failed'
            WHEN p.url IS NOT NULL THEN 'reused' WHEN b.sha IS NOT NULL THEN 'failed' ELSE 'ready' END AS delivery_status,
       'delivery' AS report_mode, count(*) OVER (PARTITION BY r.repo_id) AS reported
FROM res r
LEFT JOIN prs p ON p.repo_id = r.repo_id AND CAST(r.repo_id AS BIGINT) % 13 <> 0 AND CAST(r.repo_id AS BIGINT) % 17 <> 0
     AND p.head = concat('org', r.repo_id, ':', r.branch)
LEFT JOIN br b ON b.repo_id = r.repo_id AND b.branch = r.branch
"""


@query("remediation_run", oracle=_RUN_SQL)
def remediation_run(spark, sf_dir):
    """Plan attempts to reports in one chain. Baselines fail for repo % 6 = 0, the
    base branch is blank for repo % 13 = 0, no owner is named for repo % 17 = 0."""
    feed = lambda name: shared_sql(spark, f"WITH corpus AS ({CORPUS_SQL}), {DELIVERY_FEEDS} SELECT * FROM {name}", sf_dir)
    baseline = _baseline(spark, sf_dir)
    rid = F.col("repo_id").cast("bigint")
    repositories = baseline.select(
        "repo_id", F.lit(None).cast("string").alias("owner"),
        F.when(rid % 17 != 0, F.concat(F.lit("org"), "repo_id", F.lit("/code"))).alias("full_name"),
        F.when(rid % 13 == 0, F.lit("  ")).alias("base_override"), F.lit("main").alias("default_branch"))
    run = run_all(_files(spark, sf_dir), _candidates(spark, sf_dir), _allowlist(spark, sf_dir), contexts(spark, sf_dir),
                  plan_attempts(spark, sf_dir), baseline, validation_runs(spark, sf_dir), repositories, feed("prs"), feed("br"))
    reported = run.reports.select("repo_id", F.get_json_object("report", "$.mode").alias("report_mode"),
                                  F.json_array_length(F.get_json_object("report", "$.outcomes")).cast("bigint").alias("reported"))
    return run.deliveries.select("repo_id", "flag_name", "final_state", "status", F.size("files").cast("bigint").alias("n_files"),
                                 "delivery_status").join(reported, "repo_id")
