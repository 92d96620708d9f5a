"""Scalar Column functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flagtide.functions import text as tx
from flagtide.operators import outcomes as O
from flagtide.registry import query
from flagtide.sources.tables import read_table, shared_sql

WS = tx.WS_CLASS

# Paths taken from page URLs, with planted variants: a ``.py`` suffix,
# back-slashes, a drive letter, a ``./`` prefix, surrounding white space.
PAGE_PATHS_SQL = """
SELECT page_id,
       CASE WHEN page_id % 13 = 0 THEN concat(' ', p, chr(9))
            WHEN page_id % 11 = 0 THEN concat('./', p)
            WHEN page_id % 7 = 0 THEN concat('C:', p)
            WHEN page_id % 5 = 0 THEN replace(concat(p, '.py'), '/', chr(92))
            WHEN page_id % 3 = 0 THEN concat(p, '.PY')
            WHEN page_id % 17 = 0 THEN concat('/', p, '.py')
            WHEN page_id % 19 = 0 THEN '   '
            ELSE concat(p, '.py') END AS raw
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS p FROM pages) x
"""


@query("normalize_path", oracle=f"""
WITH f AS ({PAGE_PATHS_SQL}),
n AS (SELECT page_id, replace(regexp_replace(raw, '^{WS}+|{WS}+\\z', '', 'g'), chr(92), '/') AS p FROM f),
c AS (
  SELECT page_id, p, CASE WHEN p = '' THEN 'empty'
                          WHEN contains(p, chr(0)) THEN 'nul_byte'
                          WHEN starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') THEN 'not_relative'
                          WHEN list_has_any(string_split(p, '/'), ['', '.', '..']) THEN 'unsafe_part'
                          WHEN NOT regexp_full_match(string_split(p, '/')[-1], '.+\\.[pP][yY]') THEN 'not_python'
                     END AS error_code FROM n
)
SELECT page_id, CASE WHEN error_code IS NULL THEN p END AS path, error_code FROM c
""")
def normalize_path(spark, sf_dir):
    n = tx.normalize_path(F.col("raw"))
    return shared_sql(spark, PAGE_PATHS_SQL, sf_dir, ["pages"]).select("page_id", n["path"].alias("path"), n["error_code"].alias("error_code"))


_BRANCH_FEED = """
SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN ' *** '
                       WHEN p_partkey % 5 = 0 THEN concat('--', upper(p_type), '__', p_name, '!!')
                       WHEN p_partkey % 7 = 0 THEN concat(p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ',
                                                          p_name, ' ', p_name, ' ', p_name, ' ', p_name)
                       ELSE concat(p_type, ' ', p_name) END AS flag
FROM part
"""


@query("branch_name", oracle=f"""
WITH f AS ({_BRANCH_FEED}),
s1 AS (SELECT p_partkey, regexp_replace(lower(regexp_replace(flag, '^{WS}+|{WS}+\\z', '', 'g')), '[^a-z0-9]+', '-', 'g') AS s FROM f),
s2 AS (SELECT p_partkey, regexp_replace(left(regexp_replace(s, '^-+|-+\\z', '', 'g'), 80), '-+\\z', '', 'g') AS s FROM s1)
SELECT p_partkey, CASE WHEN s <> '' THEN concat('remediation/remove-', s) END AS branch FROM s2
""")
def branch_name(spark, sf_dir):
    return shared_sql(spark, _BRANCH_FEED, sf_dir, ["part"]).select("p_partkey", tx.branch_name("flag").alias("branch"))


@query("content_hash", oracle="""
SELECT doc_id, sha256(text) AS sha256 FROM documents
""")
def content_hash(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.content_hash(F.encode("text", "UTF-8")).alias("sha256"))


_REPO_FEED = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(lower(c_mktsegment), '/', c_name)
                       WHEN c_custkey % 3 = 1 THEN concat(lower(c_mktsegment), '/', replace(c_name, '#', '-'))
                       ELSE concat(replace(c_name, '#', '.'), '/x', chr(10)) END AS repo
FROM customer
"""


@query("repo_name_check", oracle=f"""
WITH f AS ({_REPO_FEED})
SELECT c_custkey, regexp_full_match(repo, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AS valid FROM f
""")
def repo_name_check(spark, sf_dir):
    return shared_sql(spark, _REPO_FEED, sf_dir, ["customer"]).select("c_custkey", tx.repo_name_ok("repo").alias("valid"))


RAW_RUNS_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INT) END AS returncode,
       CASE WHEN o_orderkey % 7 = 0 THEN 'TimeoutExpired' WHEN o_orderkey % 11 = 0 THEN 'OSError'
            WHEN o_orderkey % 19 = 0 THEN 'ReadTimeout' END AS error_class,
       CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 2 = 0 THEN 'the sandbox TIMED OUT'
            WHEN o_orderkey % 11 = 0 THEN 'no such file' END AS error_message,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('ran ', o_orderpriority) END AS output
FROM orders
"""


@query("classify_run", oracle=f"""
WITH r AS ({RAW_RUNS_SQL})
SELECT o_orderkey,
       CASE WHEN error_class IS NULL THEN coalesce(returncode, 1) = 0 ELSE false END AS passed,
       CASE WHEN error_class IS NULL THEN coalesce(returncode, 1) END AS returncode,
       coalesce(contains(lower(error_class), 'timeout'), false) OR coalesce(contains(lower(error_message), 'timed out'), false) AS timed_out,
       CASE WHEN error_class IS NOT NULL AND output = '' THEN
                 CASE WHEN coalesce(contains(lower(error_class), 'timeout'), false) OR coalesce(contains(lower(error_message), 'timed out'), false)
                      THEN 'Validation timed out after 300 seconds.'
                      ELSE concat('Validation execution error: ', coalesce(error_message, error_class)) END
            ELSE output END AS output
FROM r
""")
def classify_run(spark, sf_dir):
    runs = shared_sql(spark, RAW_RUNS_SQL, sf_dir)
    return O.classify_runs(runs).select("o_orderkey", "passed", "returncode", "timed_out", "output")


_BASE_FEED = """
SELECT o_orderkey,
       CASE o_orderkey % 4 WHEN 0 THEN '  release ' WHEN 1 THEN concat(chr(9), ' ') ELSE NULL END AS override,
       CASE WHEN o_orderkey % 10 = 0 THEN '   ' WHEN o_orderkey % 10 = 1 THEN ' develop' ELSE 'main' END AS default_branch
FROM orders
"""


@query("base_branch", oracle=f"""
WITH f AS ({_BASE_FEED}),
r AS (SELECT o_orderkey, regexp_replace(coalesce(override, default_branch), '^{WS}+|{WS}+\\z', '', 'g') AS b FROM f)
SELECT o_orderkey, CASE WHEN b <> '' THEN b END AS base,
       CASE WHEN b = '' THEN 'no usable base branch' END AS error
FROM r
""")
def base_branch(spark, sf_dir):
    f = shared_sql(spark, _BASE_FEED, sf_dir)
    from flagtide.operators.delivery import base_branch as resolve
    return f.select("o_orderkey", *resolve("override", "default_branch"))


@query("load_contexts", oracle=f"""
WITH c AS (
  SELECT doc_id, text, regexp_replace(text, '^{WS}+|{WS}+\\z', '', 'g') AS t,
         strlen(text) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS n_bytes FROM documents
)
SELECT doc_id,
       CAST(CASE WHEN n_bytes > 100000 OR t = '' OR length(t) > 20000 THEN NULL ELSE length(t) END AS INTEGER) AS n_chars,
       CASE WHEN n_bytes > 100000 THEN 'context file too large' WHEN t = '' THEN 'context is empty'
            WHEN length(t) > 20000 THEN 'context too long' END AS error
FROM c
""")
def load_contexts(spark, sf_dir):
    """Documents as business-context files (every third with a BOM)."""
    from flagtide.plans.discovery import load_contexts as load
    d = read_table(spark, sf_dir, "documents")
    enc = F.encode("text", "UTF-8")
    raw = d.select(F.col("doc_id").cast("string").alias("repo_id"), F.col("doc_id"),
                   F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), enc)).otherwise(enc)
                   .alias("content"))
    c = load(raw)
    return c.select(F.col("repo_id").cast("bigint").alias("doc_id"), F.length("text").alias("n_chars"), "error")
