"""Rewrite job, outcomes, gates, delivery and reports (SURVEY 2.3, 2.4, 2.5,
2.6, 2.8, 2.9) on the generated corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from flagtide.catalog.extract import _MEMO, _files
from flagtide.functions import text as tx
from flagtide.operators import delivery as D
from flagtide.operators import guards as G
from flagtide.operators import outcomes as O
from flagtide.operators import report as R
from flagtide.operators import rewrite as RW
from flagtide.registry import query
from flagtide.session import materialize
from flagtide.sources.tables import CORPUS_SQL, generated_source_files, read_table, shared_sql

# One target row per corpus file: its flag, state true for o_orderkey % 3 = 0.
TARGETS_BODY = """
t AS (SELECT repo_id, flag AS flag_name, o_orderkey % 3 = 0 AS final_state, path, k, o_orderkey, source FROM corpus),
runs AS (SELECT DISTINCT repo_id, flag AS flag_name,
                (CAST(repo_id AS BIGINT) + length(flag)) % 4 <> 0 AS passed FROM corpus)
"""

# Expected text after the rewrite, per template and state (FIXTURES.md 3).
EXPECTED_BODY = """
expected AS (
  SELECT *,
    CASE WHEN o_orderkey % 97 = 0 THEN 'failed' WHEN k IN (3, 4, 6) THEN 'unchanged' ELSE 'mutated' END AS status,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         WHEN k = 0 AND final_state THEN concat('from svc import new_f', chr(10), 'new_f()', chr(10))
         WHEN k = 0 THEN concat('from svc import old_f', chr(10), 'old_f()', chr(10))
         WHEN k = 1 AND final_state THEN concat('h = new_h', chr(10))
         WHEN k = 1 THEN concat('h = old_h', chr(10))
         WHEN k = 2 AND final_state THEN concat('if OTHER:', chr(10), '    a()', chr(10), 'else:', chr(10), '    b()', chr(10))
         WHEN k = 2 THEN concat('if OTHER:', chr(10), '    a()', chr(10), 'else:', chr(10), '    c()', chr(10))
         WHEN k = 5 AND final_state THEN concat('a()', chr(10))
         WHEN k = 5 THEN ''
         WHEN k = 7 AND final_state THEN concat('def f():', chr(13), chr(10), '    a()', chr(13), chr(10))
         WHEN k = 7 THEN concat('def f():', chr(13), chr(10), '    pass', chr(13), chr(10))
         ELSE source END AS updated
  FROM t
),
per_target AS (
  SELECT e.repo_id, e.flag_name, bool_or(e.status = 'failed') AS any_failed, bool_or(e.status = 'unchanged') AS any_unchanged,
         min(r.passed) AS passed, count(*) AS n_files
  FROM expected e JOIN runs r ON r.repo_id = e.repo_id AND r.flag_name = e.flag_name GROUP BY e.repo_id, e.flag_name
),
outcome AS (
  SELECT repo_id, flag_name, n_files,
         CASE WHEN any_failed THEN 'preparation_failed' WHEN any_unchanged THEN 'no_changes'
              WHEN NOT passed THEN 'validation_failed' ELSE 'prepared' END AS status
  FROM per_target
)
"""

ORACLE_PREFIX = f"WITH corpus AS ({CORPUS_SQL}), {TARGETS_BODY}, {EXPECTED_BODY}"


def _sql(spark, sf_dir, sql):
    return shared_sql(spark, sql, sf_dir)


def targets(spark, sf_dir):
    return _sql(spark, sf_dir, f"WITH corpus AS ({CORPUS_SQL}), {TARGETS_BODY} "
                "SELECT repo_id, flag_name, final_state, path FROM t")


def validation_runs(spark, sf_dir):
    return _sql(spark, sf_dir, f"WITH corpus AS ({CORPUS_SQL}), {TARGETS_BODY} "
                "SELECT repo_id, flag_name, passed, CAST(NULL AS STRING) AS output FROM runs")


def _once(spark, sf_dir, name, make):
    """A table written once per query run and read by all its consumers."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        _MEMO[key] = materialize(make())
    return _MEMO[key]


def rewritten(spark, sf_dir):
    return RW.rewrite_files(targets(spark, sf_dir), generated_source_files(spark, sf_dir, spread=False))


def file_changes(spark, sf_dir):
    """The rewrite result as a written table: outcomes, diffs, deliveries and
    reports read it, so the rewrite itself runs once."""
    return _once(spark, sf_dir, "file_changes", lambda: rewritten(spark, sf_dir))


def file_results(spark, sf_dir):
    """``file_changes`` without the texts, for queries that read no more: they write
    each file's status and hashes only."""
    return _once(spark, sf_dir, "file_results", lambda: rewritten(spark, sf_dir).select(
        "repo_id", "flag_name", "final_state", "path", "status", "error", "original_sha256", "updated_sha256"))


def outcomes(spark, sf_dir, results=file_results):
    return _once(spark, sf_dir, "outcomes", lambda: O.target_outcomes(
        results(spark, sf_dir), validation_runs(spark, sf_dir)))


@query("rewrite_guards", oracle=ORACLE_PREFIX + """
SELECT repo_id, path, flag_name, final_state, status, sha256(updated) AS updated_sha256 FROM expected
""")
def rewrite_guards(spark, sf_dir):
    r = rewritten(spark, sf_dir)
    return r.select("repo_id", "path", "flag_name", "final_state", "status", "updated_sha256")


@query("clean_imports", oracle=ORACLE_PREFIX + """
SELECT repo_id, path, updated FROM expected WHERE status = 'mutated'
""")
def clean_imports(spark, sf_dir):
    """The whole text of every changed file, imports cleaned."""
    return rewritten(spark, sf_dir).where(F.col("status") == "mutated").select(
        "repo_id", "path", F.col("updated_source").alias("updated"))


@query("file_status", oracle=ORACLE_PREFIX + """
SELECT repo_id, path, status, CASE WHEN status = 'failed' THEN 'SyntaxError' END AS error_class FROM expected
""")
def file_status(spark, sf_dir):
    r = rewritten(spark, sf_dir)
    return r.select("repo_id", "path", "status", F.substring_index("error", ":", 1).alias("error_class"))


@query("mutation_summary", oracle=ORACLE_PREFIX + """
SELECT repo_id, CAST(count_if(status = 'mutated') AS BIGINT) AS mutated,
       CAST(count_if(status = 'unchanged') AS BIGINT) AS unchanged, CAST(count_if(status = 'failed') AS BIGINT) AS failed
FROM expected GROUP BY repo_id
""")
def mutation_summary(spark, sf_dir):
    return RW.mutation_summary(rewritten(spark, sf_dir))


@query("target_independence", oracle=f"""
WITH corpus AS ({CORPUS_SQL}),
t AS (SELECT repo_id, flag AS flag_name, true AS final_state, path, k, o_orderkey, source FROM corpus
      UNION ALL
      SELECT repo_id, flag, false, path, k, o_orderkey, source FROM corpus),
runs AS (SELECT 1 AS x), {EXPECTED_BODY.split('per_target AS')[0].rstrip().rstrip(',')}
SELECT repo_id, path, final_state, status, sha256(updated) AS updated_sha256 FROM expected
""")
def target_independence(spark, sf_dir):
    """Every file resolved both ways; every result starts from the original bytes."""
    t = _sql(spark, sf_dir, f"WITH corpus AS ({CORPUS_SQL}) SELECT repo_id, flag AS flag_name, path FROM corpus")
    both = t.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("final_state"))
    r = RW.rewrite_files(both, _files(spark, sf_dir))
    return r.select("repo_id", "path", "final_state", "status", "updated_sha256")


# Whole diffs per template and state (FIXTURES.md 3): headers, one hunk each.
DIFF_BODY = """
hunks AS (
  SELECT repo_id, flag_name, path, CASE
    WHEN k = 0 AND final_state THEN ['@@ -1,5 +1,2 @@', '-from svc import new_f, old_f', concat('-if ', flag_name, ':'), '-    new_f()', '-else:', '-    old_f()', '+from svc import new_f', '+new_f()']
    WHEN k = 0 THEN ['@@ -1,5 +1,2 @@', '-from svc import new_f, old_f', concat('-if ', flag_name, ':'), '-    new_f()', '-else:', '-    old_f()', '+from svc import old_f', '+old_f()']
    WHEN k = 1 THEN ['@@ -1 +1 @@', concat('-h = new_h if ', flag_name, ' else old_h'), CASE WHEN final_state THEN '+h = new_h' ELSE '+h = old_h' END]
    WHEN k = 2 AND final_state THEN ['@@ -1,6 +1,4 @@', ' if OTHER:', '     a()', concat('-elif ', flag_name, ':'), '+else:', '     b()', '-else:', '-    c()']
    WHEN k = 2 THEN ['@@ -1,6 +1,4 @@', ' if OTHER:', '     a()', concat('-elif ', flag_name, ':'), '-    b()', ' else:', '     c()']
    WHEN k = 5 AND final_state THEN ['@@ -1,3 +1 @@', concat('-if ', flag_name, ':'), concat('-    if ', flag_name, ':'), '-        a()', '+a()']
    WHEN k = 5 THEN ['@@ -1,3 +0,0 @@', concat('-if ', flag_name, ':'), concat('-    if ', flag_name, ':'), '-        a()']
    ELSE ['@@ -1,3 +1,2 @@', ' def f():', concat('-    if ', flag_name, ':'), '-        a()', CASE WHEN final_state THEN '+    a()' ELSE '+    pass' END] END AS hunk
  FROM expected WHERE status = 'mutated'
),
dl AS (
  SELECT repo_id, flag_name, path, list_concat([concat('--- a/', path), concat('+++ b/', path)], hunk) AS lines,
         CAST(2 + len(hunk) AS BIGINT) AS n_lines
  FROM hunks
),
budget AS (
  SELECT *, sum(n_lines) OVER (PARTITION BY repo_id, flag_name ORDER BY path
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM dl
)
"""


def _budget_oracle(limit: int) -> str:
    return ORACLE_PREFIX + ", " + DIFF_BODY + f"""
, kept AS (SELECT repo_id, flag_name, flatten(list(lines ORDER BY path)) AS all_lines, max(upto) AS seen
           FROM budget WHERE upto - n_lines <= {limit} GROUP BY repo_id, flag_name)
SELECT repo_id, flag_name, CAST(seen AS BIGINT) AS n_lines,
       concat(array_to_string(list_slice(all_lines, 1, {limit}), chr(10)), CASE WHEN seen > {limit} THEN
              concat(chr(10), '... [diff truncated; at least ', CAST(seen - {limit} AS BIGINT), ' additional line(s)]') ELSE '' END) AS diff
FROM kept
"""


@query("unified_diff", oracle=ORACLE_PREFIX + ", " + DIFF_BODY + """
SELECT repo_id, flag_name, path, array_to_string(lines, chr(10)) AS diff FROM dl
""")
def unified_diff(spark, sf_dir):
    d = RW.file_diffs(file_changes(spark, sf_dir))
    return d.select("repo_id", "flag_name", "path", F.array_join("diff_lines", "\n").alias("diff"))


@query("diff_budget", oracle=_budget_oracle(12))
def diff_budget(spark, sf_dir):
    """Per target diff under a 12-line budget (truncation marker when over)."""
    d = RW.file_diffs(file_changes(spark, sf_dir))
    return O.diff_budget(d, ["repo_id", "flag_name"], max_lines=12).select("repo_id", "flag_name", "n_lines", "diff")


@query("report_lines_limit", oracle=_budget_oracle(5))
def report_lines_limit(spark, sf_dir):
    """First 5 diff lines of every target (the report line limit)."""
    d = RW.file_diffs(file_changes(spark, sf_dir))
    return O.diff_budget(d, ["repo_id", "flag_name"], max_lines=5).select("repo_id", "flag_name", "n_lines", "diff")


@query("target_outcome", oracle=ORACLE_PREFIX + """
SELECT repo_id, flag_name, status, CAST(CASE WHEN status = 'prepared' THEN n_files ELSE 0 END AS INTEGER) AS n_files
FROM outcome
""")
def target_outcome(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    return o.select("repo_id", "flag_name", "status", F.size("files").alias("n_files"))


@query("join_outcome_validation", oracle=ORACLE_PREFIX + """
SELECT p.repo_id, p.flag_name, r.passed AS validation_passed FROM per_target p
JOIN runs r ON r.repo_id = p.repo_id AND r.flag_name = p.flag_name
""")
def join_outcome_validation(spark, sf_dir):
    return outcomes(spark, sf_dir).select("repo_id", "flag_name", "validation_passed")


@query("join_targets_files", oracle=ORACLE_PREFIX + """
SELECT repo_id, flag_name, CASE WHEN o_orderkey % 23 = 0 THEN concat('gone/', path) ELSE path END AS path,
       CASE WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE status END AS status,
       CASE WHEN o_orderkey % 23 = 0 THEN concat('file not found: gone/', path) END AS not_found,
       CASE WHEN o_orderkey % 23 <> 0 AND status <> 'failed' THEN sha256(source) END AS original_sha256
FROM expected
""")
def join_targets_files(spark, sf_dir):
    """The rewrite on targets of which every 23rd names a file that does not exist."""
    t = _sql(spark, sf_dir, f"WITH corpus AS ({CORPUS_SQL}), {TARGETS_BODY} SELECT repo_id, flag_name, final_state, "
             "CASE WHEN o_orderkey % 23 = 0 THEN concat('gone/', path) ELSE path END AS path FROM t")
    r = RW.rewrite_files(t, _files(spark, sf_dir))
    return r.select("repo_id", "flag_name", "path", "status", F.when(F.col("error").startswith("file not found"), F.col("error"))
                    .alias("not_found"), "original_sha256")


@query("join_stale_snapshot", oracle=f"""
WITH corpus AS ({CORPUS_SQL})
SELECT repo_id, path, o_orderkey % 10 = 0 AS vanished FROM corpus WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0
""")
def join_stale_snapshot(spark, sf_dir):
    """Snapshot hashes vs current files: every 9th changed, every 10th removed."""
    corpus = _sql(spark, sf_dir, CORPUS_SQL)
    snap = corpus.select("repo_id", "path", F.sha2(F.encode("source", "UTF-8"), 256).alias("sha256"))
    cur = corpus.where(F.col("o_orderkey") % 10 != 0).select(
        "repo_id", "path", F.sha2(F.encode(F.when(F.col("o_orderkey") % 9 == 0, F.concat("source", F.lit("#")))
                                           .otherwise(F.col("source")), "UTF-8"), 256).alias("sha256"))
    stale = O.stale_snapshots(snap, cur)
    return stale.select("repo_id", "path", F.col("current_sha256").isNull().alias("vanished"))


@query("gate_all_or_nothing", oracle="""
SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS group_failed FROM lineitem
""")
def gate_all_or_nothing(spark, sf_dir):
    """Line items per order: one returned item vetoes the whole order."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    g = RW.gate_all_or_nothing(li, ["l_orderkey"], F.col("l_returnflag") == "R")
    return g.select("l_orderkey", "l_linenumber", "group_failed")


@query("baseline_gate", oracle=f"""
WITH corpus AS ({CORPUS_SQL}),
per AS (SELECT repo_id, count(*) AS n FROM corpus GROUP BY repo_id),
base AS (SELECT CAST(c_custkey AS STRING) AS repo_id, c_custkey % 6 <> 0 AS passed FROM customer WHERE c_custkey % 10 <> 0)
SELECT p.repo_id, CAST(p.n AS BIGINT) AS n_targets,
       CASE WHEN b.passed IS NULL THEN 'baseline_missing' WHEN NOT b.passed THEN 'baseline_failed' ELSE 'proceed' END AS decision
FROM per p LEFT JOIN base b ON b.repo_id = p.repo_id
""")
def baseline_gate(spark, sf_dir):
    """Baseline test run per repo (failing for customers % 6, missing for % 10)."""
    cust = read_table(spark, sf_dir, "customer")
    base = cust.where(F.col("c_custkey") % 10 != 0).select(
        F.col("c_custkey").cast("string").alias("repo_id"), (F.col("c_custkey") % 6 != 0).alias("passed"))
    return O.baseline_gate(targets(spark, sf_dir), base)


@query("prep_summary", oracle=ORACLE_PREFIX + """
SELECT repo_id, CAST(count(*) AS BIGINT) AS targets, CAST(count_if(status = 'prepared') AS BIGINT) AS prepared,
       CAST(count_if(status <> 'prepared') AS BIGINT) AS failed
FROM outcome GROUP BY repo_id
""")
def prep_summary(spark, sf_dir):
    return R.prep_summary(outcomes(spark, sf_dir))


@query("has_failures", oracle=ORACLE_PREFIX + """
SELECT repo_id, bool_or(status <> 'prepared') AS has_failures FROM outcome GROUP BY repo_id
""")
def has_failures(spark, sf_dir):
    return R.has_failures(outcomes(spark, sf_dir))


@query("sort_changes", oracle=ORACLE_PREFIX + """
SELECT e.repo_id, e.flag_name, string_agg(e.path, ',' ORDER BY e.path) AS paths
FROM expected e JOIN outcome o ON o.repo_id = e.repo_id AND o.flag_name = e.flag_name
WHERE o.status = 'prepared' GROUP BY e.repo_id, e.flag_name
""")
def sort_changes(spark, sf_dir):
    o = outcomes(spark, sf_dir).where(F.col("status") == "prepared")
    return o.select("repo_id", "flag_name", F.array_join(F.array_sort(
        F.transform("files", lambda f: f["path"])), ",").alias("paths"))


@query("sink_file_changes", oracle=ORACLE_PREFIX + """
SELECT repo_id, flag_name, path, o_orderkey % 5 = 0 AS had_bom,
       sha256(CASE WHEN o_orderkey % 5 = 0 THEN encode(chr(65279)) || encode(updated) ELSE encode(updated) END) AS updated_sha256,
       true AS bytes_match
FROM expected WHERE status = 'mutated'
""")
def sink_file_changes(spark, sf_dir):
    """Complete replacement files (bytes, with the BOM that every 5th source has)
    written as parquet, read back, and hashed against the recorded hash."""
    corpus = _sql(spark, sf_dir, CORPUS_SQL)
    body = F.encode("source", "UTF-8")
    files = corpus.select("repo_id", "path", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(G.UTF8_BOM), body))
                          .otherwise(body).alias("content"))
    r = RW.rewrite_files(targets(spark, sf_dir), files).where(F.col("status") == "mutated").select(
        "repo_id", "flag_name", "path", "had_bom", "updated_bytes", "original_sha256", "updated_sha256")
    out = R.output_root(spark) + "/file_changes"
    R.write_table(r.withColumn("bucket", F.pmod(F.xxhash64("repo_id", "path"), F.lit(64))), out, partition_by=["bucket"])
    back = spark.read.parquet(out)
    return back.select("repo_id", "flag_name", "path", "had_bom", "updated_sha256",
                       (F.sha2("updated_bytes", 256) == F.col("updated_sha256")).alias("bytes_match"))


@query("changed_files", oracle=ORACLE_PREFIX + """
SELECT e.repo_id, e.flag_name, e.path, e.updated AS updated_source, sha256(e.updated) AS updated_sha256, 'b' AS run_id
FROM expected e JOIN outcome o ON o.repo_id = e.repo_id AND o.flag_name = e.flag_name WHERE o.status = 'prepared'
""")
def changed_files(spark, sf_dir):
    """The complete new sources of prepared targets, handed over through the
    outbox: two runs write to it, the second one twice, and its files are read."""
    changed = O.changed_files(file_changes(spark, sf_dir), outcomes(spark, sf_dir, file_changes))
    out = R.output_root(spark) + "/outbox"
    for run in ("a", "b", "b"):
        R.write_outbox(changed, out, run)
    return R.read_outbox(spark, out, "b").select(
        "repo_id", "flag_name", "path", F.decode("updated_bytes", "UTF-8").alias("updated_source"), "updated_sha256",
        F.lit("b").alias("run_id"))


# --- delivery ---------------------------------------------------------------

DELIVERY_FEEDS = """
prs AS (SELECT DISTINCT repo_id, 'main' AS base,
               concat('org', repo_id, ':remediation/remove-', replace(lower(flag), '_', '-')) AS head,
               concat('https://example.invalid/pr/', repo_id) AS url, CAST(repo_id AS INT) AS number,
               concat('h', repo_id) AS head_sha
        FROM corpus WHERE CAST(repo_id AS BIGINT) % 5 = 0),
br AS (SELECT DISTINCT repo_id, concat('remediation/remove-', replace(lower(flag), '_', '-')) AS branch,
              concat('b', repo_id) AS sha FROM corpus WHERE CAST(repo_id AS BIGINT) % 7 = 0)
"""


def _delivery_inputs(spark, sf_dir):
    """Outcomes with owner and base branch (blank override for repo % 13 = 0),
    open requests and existing branches."""
    prs = _sql(spark, sf_dir, f"WITH corpus AS ({CORPUS_SQL}), {DELIVERY_FEEDS} SELECT * FROM prs")
    br = _sql(spark, sf_dir, f"WITH corpus AS ({CORPUS_SQL}), {DELIVERY_FEEDS} SELECT * FROM br")
    o = outcomes(spark, sf_dir)
    rid = F.col("repo_id").cast("bigint")
    base, _ = D.base_branch(F.when(rid % 13 == 0, F.lit("  ")), F.lit("main"))
    o = o.select("*", F.concat(F.lit("org"), F.col("repo_id")).alias("owner"), base)
    return o, prs, br


def deliveries(spark, sf_dir):
    o, prs, br = _delivery_inputs(spark, sf_dir)
    return D.delivery_status(o, prs, br)


_DELIVERY_ORACLE = ORACLE_PREFIX + ", " + DELIVERY_FEEDS + """
, d AS (
  SELECT o.repo_id, o.flag_name, o.status,
         CASE WHEN o.status <> 'prepared' THEN 'not_prepared'
              WHEN CAST(o.repo_id AS BIGINT) % 13 = 0 THEN 'failed'
              WHEN p.url IS NOT NULL THEN 'reused'
              WHEN b.sha IS NOT NULL THEN 'failed'
              ELSE 'ready' END AS delivery_status,
         p.url AS pr_url
  FROM outcome o
  LEFT JOIN prs p ON p.repo_id = o.repo_id AND CAST(o.repo_id AS BIGINT) % 13 <> 0
       AND p.head = concat('org', o.repo_id, ':remediation/remove-', replace(lower(o.flag_name), '_', '-'))
  LEFT JOIN br b ON b.repo_id = o.repo_id AND b.branch = concat('remediation/remove-', replace(lower(o.flag_name), '_', '-'))
)
"""


@query("delivery_status", oracle=_DELIVERY_ORACLE + """
SELECT repo_id, flag_name, delivery_status FROM d
""")
def delivery_status(spark, sf_dir):
    return deliveries(spark, sf_dir).select("repo_id", "flag_name", "delivery_status")


@query("join_open_pr", oracle=_DELIVERY_ORACLE + """
SELECT repo_id, flag_name, pr_url FROM d
""")
def join_open_pr(spark, sf_dir):
    o, prs, _ = _delivery_inputs(spark, sf_dir)
    t = o.withColumn("head", F.concat(F.col("owner"), F.lit(":"), tx.branch_name("flag_name")))
    return D.join_open_pr(t, prs).select("repo_id", "flag_name", F.col("pr.url").alias("pr_url"))


@query("join_branch_conflict", oracle=ORACLE_PREFIX + ", " + DELIVERY_FEEDS + """
SELECT o.repo_id, o.flag_name, b.sha IS NOT NULL AS branch_exists FROM outcome o
LEFT JOIN br b ON b.repo_id = o.repo_id AND b.branch = concat('remediation/remove-', replace(lower(o.flag_name), '_', '-'))
""")
def join_branch_conflict(spark, sf_dir):
    o, _, br = _delivery_inputs(spark, sf_dir)
    t = o.withColumn("branch_name", tx.branch_name("flag_name"))
    return D.join_branch_conflict(t, br).select("repo_id", "flag_name", "branch_exists")


@query("delivery_summary", oracle=_DELIVERY_ORACLE + """
SELECT repo_id, CAST(count(*) AS BIGINT) AS targets, CAST(count_if(status = 'prepared') AS BIGINT) AS prepared,
       CAST(count_if(delivery_status IN ('ready', 'reused')) AS BIGINT) AS delivered_or_reused,
       CAST(count_if(delivery_status = 'failed') AS BIGINT) AS delivery_failed,
       CAST(count_if(delivery_status = 'not_prepared') AS BIGINT) AS not_prepared
FROM d GROUP BY repo_id
""")
def delivery_summary(spark, sf_dir):
    return R.delivery_summary(deliveries(spark, sf_dir))


@query("pr_text", oracle=ORACLE_PREFIX + """
SELECT o.repo_id, o.flag_name, concat('Remove deprecated feature flag: ', o.flag_name) AS title,
       concat('chore: remove deprecated feature flag ', o.flag_name) AS commit_message,
       concat('Automated removal of a retired feature flag.', chr(10), chr(10), 'Deprecated feature flag: `', o.flag_name, '`',
              chr(10), chr(10), 'Changed files:', chr(10),
              string_agg(concat('- `', e.path, '`'), chr(10) ORDER BY e.path), chr(10), chr(10),
              'The change was produced by a deterministic source rewrite and must still be reviewed by a maintainer before merging.') AS body
FROM outcome o JOIN expected e ON e.repo_id = o.repo_id AND e.flag_name = o.flag_name
WHERE o.status = 'prepared' GROUP BY o.repo_id, o.flag_name
""")
def pr_text(spark, sf_dir):
    o = outcomes(spark, sf_dir).where(F.col("status") == "prepared")
    paths = F.transform("files", lambda f: f["path"])
    return o.select("repo_id", "flag_name", *D.pr_text(F.col("flag_name"), paths))


# Every field of a report, one row per target (FIXTURES.md): validation runs have
# no output, code or time-out in the feed, baselines pass unless repo % 6 = 0.
REPORT_SCHEMA = """mode string, model string, repository string, schema_version int, validation_mode string,
  base_branch string, host_repository string,
  baseline_validation struct<output:string,passed:boolean,returncode:int,timed_out:boolean>,
  discovery struct<candidate_flags:array<string>,n_allowlist:bigint,targets:array<struct<files:bigint,final_state:boolean,flag_name:string>>>,
  deliveries array<struct<error:string,flag_name:string,status:string,
    pull_request:struct<branch_name:string,commit_sha:string,pr_number:int,reused_existing_pr:boolean,url:string>>>,
  outcomes array<struct<diff:string,error:string,files:array<struct<original_sha256:string,path:string,updated_sha256:string>>,
    final_state:boolean,flag_name:string,status:string,
    validation:struct<output:string,passed:boolean,returncode:int,timed_out:boolean>>>,
  summary struct<targets:bigint,prepared:bigint,failed:bigint,delivered_or_reused:bigint,delivery_failed:bigint,not_prepared:bigint>"""

_REPORT_TARGETS = """
, per AS (SELECT repo_id, count(*) AS targets, CAST(count_if(status = 'prepared') AS BIGINT) AS prepared FROM outcome GROUP BY repo_id),
fl AS (SELECT e.repo_id, e.flag_name, string_agg(concat_ws('|', e.path, sha256(e.source), sha256(e.updated)), ',' ORDER BY e.path) AS files,
              min(CASE WHEN e.status = 'unchanged' THEN 1 END) AS u,
              string_agg(CASE WHEN e.status = 'unchanged' THEN e.path END, ', ' ORDER BY e.path) AS unchanged,
              bool_or(e.final_state) AS any_state
       FROM expected e GROUP BY e.repo_id, e.flag_name),
rep AS (
  SELECT o.repo_id, o.flag_name, o.status, t.passed AS validation_passed, p.targets, p.prepared,
         CAST(o.repo_id AS BIGINT) % 6 <> 0 AS baseline_passed, coalesce(CASE WHEN o.status = 'prepared' THEN f.files END, '') AS files,
         CASE o.status WHEN 'preparation_failed' THEN 'SyntaxError'
              WHEN 'no_changes' THEN concat('The deterministic transformer made no change in: ', f.unchanged)
              WHEN 'validation_failed' THEN 'Post-mutation validation failed.' END AS error,
         c.n AS n_targets, al.n AS n_allowlist
  FROM outcome o JOIN per p ON p.repo_id = o.repo_id JOIN fl f ON f.repo_id = o.repo_id AND f.flag_name = o.flag_name
  JOIN per_target t ON t.repo_id = o.repo_id AND t.flag_name = o.flag_name
  JOIN (SELECT repo_id, count(DISTINCT flag) AS n FROM corpus GROUP BY repo_id) c ON c.repo_id = o.repo_id
  JOIN (SELECT repo_id, count(DISTINCT path) AS n FROM corpus GROUP BY repo_id) al ON al.repo_id = o.repo_id
)
"""


def _baseline(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("repo_id"), (F.col("c_custkey") % 6 != 0).alias("passed"))


def _discovery(spark, sf_dir):
    """Per repository: the targets it goes on with, flags and allowlist size (the
    allowlist itself is a table of rows, see ``discovery_audit``)."""
    t = targets(spark, sf_dir)
    per = t.groupBy("repo_id", "flag_name").agg(F.first("final_state").alias("final_state"), F.count(F.lit(1)).alias("files"))
    allow = G.path_allowlist(generated_source_files(spark, sf_dir, spread=False)).where("error_code is null").groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_allowlist"))
    return per.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("flag_name", "final_state", "files"))).alias("t")).join(
        allow, "repo_id").select("repo_id", F.struct(
            F.transform("t", lambda x: x["flag_name"]).alias("candidate_flags"), "n_allowlist",
            F.transform("t", lambda x: F.struct(x["files"].alias("files"), x["final_state"].alias("final_state"),
                                                x["flag_name"].alias("flag_name"))).alias("targets")).alias("discovery"))


def _read_back(reports):
    """One row per outcome of the report documents, with the envelope beside it."""
    r = reports.select("repo_id", F.from_json("report", REPORT_SCHEMA).alias("r"))
    o = r.select("repo_id", "r", F.explode("r.outcomes").alias("o"))
    files = F.array_join(F.transform("o.files", lambda f: F.concat_ws("|", f["path"], f["original_sha256"], f["updated_sha256"])), ",")
    error = F.when(F.col("o.status") == "preparation_failed", F.substring_index("o.error", ":", 1)).otherwise(F.col("o.error"))
    return o.select("repo_id", "r", F.col("o.flag_name").alias("flag_name"), F.col("o.status").alias("status"),
                    F.col("o.validation.passed").alias("validation_passed"), F.col("r.summary.targets").alias("targets"),
                    F.col("r.summary.prepared").alias("prepared"), F.col("r.baseline_validation.passed").alias("baseline_passed"),
                    files.alias("files"), error.alias("error"), F.size("r.discovery.targets").cast("bigint").alias("n_targets"),
                    F.col("r.discovery.n_allowlist").alias("n_allowlist"), F.col("o.diff").alias("diff"))


_REPORT_COLUMNS = ["repo_id", "flag_name", "status", "validation_passed", "targets", "prepared", "baseline_passed", "files",
                   "error", "n_targets", "n_allowlist"]


def _prep_reports(spark, sf_dir, with_diff=True):
    o = outcomes(spark, sf_dir, file_changes if with_diff else file_results)
    d = O.diff_budget(RW.file_diffs(file_changes(spark, sf_dir)), ["repo_id", "flag_name"]) if with_diff else None
    return R.repo_report(R.prep_records(o, d), R.prep_summary(o), baseline=_baseline(spark, sf_dir),
                         discovery=_discovery(spark, sf_dir))


@query("prep_report", oracle=ORACLE_PREFIX + ", " + DIFF_BODY + _REPORT_TARGETS + """
SELECT rep.*, 'dry_run' AS mode, 1 AS schema_version, repo_id AS repository,
       CASE WHEN status = 'prepared' THEN (SELECT CAST(least(sum(n_lines), 401) AS INTEGER) FROM dl
            WHERE dl.repo_id = rep.repo_id AND dl.flag_name = rep.flag_name) END AS n_diff_lines
FROM rep
""")
def prep_report(spark, sf_dir):
    r = _read_back(_prep_reports(spark, sf_dir))
    return r.select(*_REPORT_COLUMNS, "r.mode", "r.schema_version", "r.repository",
                    F.size(F.split("diff", "\n")).alias("n_diff_lines")).withColumn(
        "n_diff_lines", F.when(F.col("n_diff_lines") >= 0, F.col("n_diff_lines")))


@query("delivery_report", oracle=_DELIVERY_ORACLE + _REPORT_TARGETS + """
, ds AS (SELECT repo_id, CAST(count_if(delivery_status IN ('ready', 'reused')) AS BIGINT) AS delivered_or_reused,
                CAST(count_if(delivery_status = 'failed') AS BIGINT) AS delivery_failed,
                CAST(count_if(delivery_status = 'not_prepared') AS BIGINT) AS not_prepared
         FROM d GROUP BY repo_id)
SELECT rep.*, 'delivery' AS mode, ds.delivered_or_reused, ds.delivery_failed, ds.not_prepared,
       d.delivery_status, CASE WHEN d.delivery_status = 'reused' THEN d.pr_url END AS reused_url,
       CASE WHEN CAST(rep.repo_id AS BIGINT) % 13 <> 0 THEN 'main' END AS base_branch, concat('org', rep.repo_id, '/code') AS host_repository
FROM rep JOIN ds ON ds.repo_id = rep.repo_id JOIN d ON d.repo_id = rep.repo_id AND d.flag_name = rep.flag_name
""")
def delivery_report(spark, sf_dir):
    """Preparation records and deliveries side by side in one document."""
    d = _once(spark, sf_dir, "deliveries", lambda: deliveries(spark, sf_dir).select(
        "repo_id", "flag_name", "owner", "base", "status", "branch_name", "delivery_status", "delivery_error",
        "pr_url", "pr_number", "commit_sha"))  # files stay with the outcomes
    o = outcomes(spark, sf_dir)
    repos = d.groupBy("repo_id").agg(F.concat(F.first("owner"), F.lit("/code")).alias("host_repository"),
                                     F.first("base").alias("base_branch"))
    reports = R.repo_report(R.prep_records(o), R.delivery_summary(d).join(R.prep_summary(o).select("repo_id", "failed"), "repo_id"),
                            mode="delivery", deliveries=R.delivery_records(d), baseline=_baseline(spark, sf_dir),
                            discovery=_discovery(spark, sf_dir), repositories=repos)
    r = _read_back(reports)
    own = F.filter("r.deliveries", lambda x: x["flag_name"] == F.col("flag_name"))[0]
    return r.withColumn("own", own).select(
        *_REPORT_COLUMNS, "r.mode", "r.summary.delivered_or_reused", "r.summary.delivery_failed", "r.summary.not_prepared",
        F.col("own.status").alias("delivery_status"),
        F.when(F.col("own.status") == "reused", F.col("own.pull_request.url")).alias("reused_url"), "r.base_branch",
        "r.host_repository")


@query("sink_report", oracle=ORACLE_PREFIX + _REPORT_TARGETS + """
SELECT * FROM rep
""")
def sink_report(spark, sf_dir):
    """Report documents written as JSON lines, read back, every record compared."""
    out = R.output_root(spark) + "/reports"
    R.write_table(_prep_reports(spark, sf_dir, with_diff=False), out, fmt="json")
    return _read_back(spark.read.schema("repo_id string, report string").json(out)).select(*_REPORT_COLUMNS)
