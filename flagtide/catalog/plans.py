"""Plan reading, rules and validation joins (SURVEY 2.1 read_plans, 2.2 rules,
2.3 joins, 2.5 resolve_attempts / first_violation, 2.7 set operations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flagtide.catalog.extract import PLANTED_GUARDS_SQL, _candidates, _files
from flagtide.operators import guards as G
from flagtide.plans import validate as V
from flagtide.plans.discovery import PROMPT_RULES, RETRY_HEAD, RETRY_TAIL
from flagtide.registry import query
from flagtide.session import materialize
from flagtide.sources.tables import CORPUS_SQL, read_table, shared_sql

# Proposed files per (repo, flag), planted from the corpus with faults chosen
# by o_orderkey % 13: 1 path outside the allowlist, 2 file omitted, 3 unknown
# flag, 4 path listed twice, 5 unsafe ``./`` path, 6 back-slashed path (valid
# after normalisation), 7 an extra allowlisted file without the flag.
PROPOSALS_BODY = """
failed_repo AS (SELECT DISTINCT repo_id FROM corpus WHERE o_orderkey % 97 = 0),
g AS (SELECT * FROM corpus WHERE o_orderkey % 97 <> 0 AND k IN (0, 1, 2, 5, 7)
      AND repo_id NOT IN (SELECT repo_id FROM failed_repo)),
proposal AS (
  SELECT repo_id, CASE WHEN o_orderkey % 13 = 3 THEN concat('UNKNOWN_', flag) ELSE flag END AS flag_name,
         CASE WHEN o_orderkey % 13 = 1 THEN concat('missing/', path)
              WHEN o_orderkey % 13 = 5 THEN concat('./', path)
              WHEN o_orderkey % 13 = 6 THEN replace(path, '/', chr(92))
              ELSE path END AS raw_path, o_orderkey
  FROM g WHERE o_orderkey % 13 <> 2
  UNION ALL SELECT repo_id, flag, path, o_orderkey FROM g WHERE o_orderkey % 13 = 4
  UNION ALL SELECT g.repo_id, g.flag, min(c.path), min(g.o_orderkey) + 1000000000
  FROM g JOIN corpus c ON c.repo_id = g.repo_id AND c.k = 4 AND c.o_orderkey % 97 <> 0
  WHERE g.o_orderkey % 13 = 7 GROUP BY g.repo_id, g.flag
)
"""


def _literal(text: str) -> str:
    """A text as a DuckDB expression."""
    return "concat(" + ", chr(10), ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n")) + ")"


CONTEXT_SQL = """
SELECT CAST(c_custkey AS STRING) AS repo_id,
       concat('  ', c_name, ' owns these switches; segment ', c_mktsegment, chr(10)) AS text
FROM customer
"""


def proposals(spark, sf_dir):
    return shared_sql(spark, f"WITH corpus AS ({CORPUS_SQL}), {PROPOSALS_BODY} "
                      "SELECT repo_id, flag_name, raw_path, o_orderkey FROM proposal", sf_dir)


def contexts(spark, sf_dir):
    return shared_sql(spark, CONTEXT_SQL, sf_dir, ["customer"])


def _target_seed(col_repo="repo_id", col_flag="flag_name"):
    return F.col(col_repo).cast("bigint") + F.length(col_flag)


def plan_attempts(spark, sf_dir):
    """``plan_attempts(repo_id, attempt, status, error, payload)`` built by Spark
    from the planted proposals: attempt 1 carries the planted faults plus
    schema faults (string ``final_state`` for repo % 23 = 0, an extra field for
    repo % 29 = 0); repos with repo % 3 = 0 get a clean attempt 2 built from the
    candidates; attempt 1 of repo % 31 = 0 did not complete."""
    p = proposals(spark, sf_dir)
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("repo_id"), "c_name")
    seed = _target_seed()
    business_quote = F.when(seed % 5 != 0, F.col("c_name")).otherwise(F.lit("words nobody wrote"))
    t = (p.groupBy("repo_id", "flag_name")
         .agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "raw_path"))),
                          lambda s: s["raw_path"]).alias("files_affected"))
         .join(cust, "repo_id", "left"))
    target = F.struct(
        F.col("flag_name"), (seed % 2 == 0).alias("final_state"), F.col("files_affected"),
        F.array(F.struct(F.lit("business_context").alias("source"), business_quote.alias("quote"),
                         F.lit("stated by the owner").alias("explanation")),
                F.struct(F.lit("repository").alias("source"), F.concat(F.lit("if "), F.col("flag_name")).alias("quote"),
                         F.lit("guard in code").alias("explanation"))).alias("evidence"))
    rid = F.col("repo_id").cast("bigint")
    first = (t.groupBy("repo_id").agg(F.array_sort(F.collect_list(target)).alias("targets"))
             .select("repo_id", F.to_json(F.struct("targets")).alias("payload")))
    payload = F.col("payload")
    payload = F.when(rid % 23 == 0, F.regexp_replace(payload, '"final_state":(true|false)', '"final_state":"$1"')) \
        .otherwise(payload)
    payload = F.when(rid % 29 == 0, F.regexp_replace(payload, '"flag_name":', '"note":"x","flag_name":')) \
        .otherwise(payload)
    a1 = first.select("repo_id", F.lit(1).alias("attempt"),
                      F.when(rid % 31 == 0, F.lit("incomplete")).otherwise(F.lit("completed")).alias("status"),
                      F.lit(None).cast("string").alias("error"), payload.alias("payload"))
    cands = _candidates(spark, sf_dir)
    clean_t = cands.join(cust, "repo_id", "left").select(
        "repo_id", F.struct(
            F.col("flag_name"), (seed % 2 == 0).alias("final_state"), F.col("files").alias("files_affected"),
            F.array(F.struct(F.lit("business_context").alias("source"), F.col("c_name").alias("quote"),
                             F.lit("stated by the owner").alias("explanation"))).alias("evidence")).alias("t"))
    a2 = (clean_t.where(F.col("repo_id").cast("bigint") % 3 == 0).groupBy("repo_id")
          .agg(F.array_sort(F.collect_list("t")).alias("targets"))
          .select("repo_id", F.lit(2).alias("attempt"), F.lit("completed").alias("status"),
                  F.lit(None).cast("string").alias("error"), F.to_json(F.struct("targets")).alias("payload")))
    return a1.unionByName(a2)


def _parsed(spark, sf_dir):
    """Parsed plans and targets, written once per query run (every check reads them)."""
    from flagtide.catalog.extract import _MEMO
    from flagtide.session import materialize

    key = ("parsed", spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        plans, targets = V.parse_plans(materialize(plan_attempts(spark, sf_dir)))
        _MEMO[key] = (plans, materialize(targets))
    return _MEMO[key]


def _allowlist(spark, sf_dir):
    return G.path_allowlist(_files(spark, sf_dir)).where(F.col("error_code").isNull())


# --- oracle building blocks (DuckDB) -----------------------------------------

_ORACLE_TARGETS = f"""
WITH {PLANTED_GUARDS_SQL},
{PROPOSALS_BODY},
cand AS (SELECT repo_id, flag_name, file_path FROM occ WHERE repo_id NOT IN (SELECT repo_id FROM failed)),
cand_flags AS (SELECT DISTINCT repo_id, flag_name FROM cand),
cand_files AS (SELECT DISTINCT repo_id, flag_name, file_path AS path FROM cand),
allow AS (SELECT DISTINCT repo_id, path FROM corpus),
tgt AS (
  SELECT repo_id, flag_name, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY flag_name) AS INTEGER) AS ordinal
  FROM (SELECT DISTINCT repo_id, flag_name FROM proposal) x
),
pf AS (
  SELECT p.repo_id, p.flag_name, t.ordinal, p.raw_path,
         replace(p.raw_path, chr(92), '/') AS npath
  FROM proposal p JOIN tgt t ON t.repo_id = p.repo_id AND t.flag_name = p.flag_name
),
pfn AS (
  SELECT *, CASE WHEN npath = '' THEN 'empty'
                 WHEN starts_with(npath, '/') OR regexp_matches(npath, '^[A-Za-z]:') THEN 'not_relative'
                 WHEN list_has_any(string_split(npath, '/'), ['', '.', '..']) THEN 'unsafe_part'
                 WHEN NOT ends_with(lower(npath), '.py') THEN 'not_python' END AS error_code
  FROM pf
),
good_pf AS (SELECT * FROM pfn WHERE error_code IS NULL),
tgt2 AS (
  SELECT repo_id, flag_name, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY flag_name) AS INTEGER) AS ordinal
  FROM cand_flags WHERE CAST(repo_id AS BIGINT) % 3 = 0
)
"""


@query("join_unknown_flags", oracle=_ORACLE_TARGETS + """
SELECT DISTINCT t.repo_id, t.flag_name FROM tgt t
WHERE NOT EXISTS (SELECT 1 FROM cand_flags c WHERE c.repo_id = t.repo_id AND c.flag_name = t.flag_name)
""")
def join_unknown_flags(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    t1 = targets
    return V.join_unknown_flags(t1, _candidates(spark, sf_dir)).select("repo_id", "flag_name").distinct()


@query("normalize_model_paths", oracle=_ORACLE_TARGETS + """
SELECT repo_id, 1 AS attempt, flag_name, raw_path, CASE WHEN error_code IS NULL THEN npath END AS path, error_code FROM pfn
UNION ALL
SELECT t.repo_id, 2, t.flag_name, c.path, c.path, NULL FROM tgt2 t
JOIN cand_files c ON c.repo_id = t.repo_id AND c.flag_name = t.flag_name
""")
def normalize_model_paths(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    f = V.target_files(targets)
    return f.select("repo_id", "attempt", "flag_name", "raw_path", "path", "error_code")


@query("join_hallucinated_paths", oracle=_ORACLE_TARGETS + """
SELECT repo_id, flag_name, npath AS path FROM good_pf p
WHERE NOT EXISTS (SELECT 1 FROM allow a WHERE a.repo_id = p.repo_id AND a.path = p.npath)
""")
def join_hallucinated_paths(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    f = V.target_files(targets)
    return V.join_hallucinated_paths(f, _allowlist(spark, sf_dir)).select("repo_id", "flag_name", "path")


@query("join_unrelated_paths", oracle=_ORACLE_TARGETS + """
SELECT repo_id, flag_name, npath AS path FROM good_pf p
WHERE EXISTS (SELECT 1 FROM allow a WHERE a.repo_id = p.repo_id AND a.path = p.npath)
  AND NOT EXISTS (SELECT 1 FROM cand_files c WHERE c.repo_id = p.repo_id AND c.flag_name = p.flag_name
                  AND c.path = p.npath)
""")
def join_unrelated_paths(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    f = V.target_files(targets)
    return V.join_unrelated_paths(f, _allowlist(spark, sf_dir), _candidates(spark, sf_dir)).select(
        "repo_id", "flag_name", "path")


@query("join_omitted_paths", oracle=_ORACLE_TARGETS + """
SELECT t.repo_id, t.flag_name, c.path FROM tgt t JOIN cand_files c ON c.repo_id = t.repo_id AND c.flag_name = t.flag_name
WHERE NOT EXISTS (SELECT 1 FROM good_pf p WHERE p.repo_id = t.repo_id AND p.flag_name = t.flag_name AND p.npath = c.path)
""")
def join_omitted_paths(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    t1 = targets
    return V.join_omitted_paths(t1, V.target_files(t1), _candidates(spark, sf_dir)).select(
        "repo_id", "flag_name", "path")


@query("set_difference", oracle=_ORACLE_TARGETS + """
SELECT t.repo_id, 1 AS attempt, t.flag_name,
       (SELECT CAST(count(DISTINCT p.npath) AS BIGINT) FROM good_pf p WHERE p.repo_id = t.repo_id AND p.flag_name = t.flag_name
          AND NOT EXISTS (SELECT 1 FROM cand_files c WHERE c.repo_id = p.repo_id AND c.flag_name = p.flag_name AND c.path = p.npath)) AS n_extra,
       (SELECT CAST(count(*) AS BIGINT) FROM cand_files c WHERE c.repo_id = t.repo_id AND c.flag_name = t.flag_name
          AND NOT EXISTS (SELECT 1 FROM good_pf p WHERE p.repo_id = c.repo_id AND p.flag_name = c.flag_name AND p.npath = c.path)) AS n_missing
FROM tgt t
UNION ALL SELECT repo_id, 2, flag_name, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM tgt2
""")
def set_difference(spark, sf_dir):
    """Per target: proposed minus candidate files and candidate minus proposed, as array ops."""
    _, targets = _parsed(spark, sf_dir)
    key = ["repo_id", "attempt", "flag_name"]
    prop = V.target_files(targets).groupBy(*key).agg(
        F.collect_set(F.when(F.col("error_code").isNull(), F.col("path"))).alias("proposed"))
    c = _candidates(spark, sf_dir).select("repo_id", "flag_name", "files")
    j = targets.select(*key).join(prop, key, "left").join(c, ["repo_id", "flag_name"], "left")
    prop_c = F.coalesce("proposed", F.array().cast("array<string>"))
    files_c = F.coalesce("files", F.array().cast("array<string>"))
    return j.select(*key,
                    F.size(F.array_except(prop_c, files_c)).cast("bigint").alias("n_extra"),
                    F.size(F.array_except(files_c, prop_c)).cast("bigint").alias("n_missing"))


@query("set_equality", oracle=_ORACLE_TARGETS + """
, pset AS (SELECT repo_id, flag_name, string_agg(DISTINCT npath, ',' ORDER BY npath) AS s FROM good_pf GROUP BY ALL),
cset AS (SELECT repo_id, flag_name, string_agg(path, ',' ORDER BY path) AS s FROM cand_files GROUP BY ALL)
SELECT t.repo_id, 1 AS attempt, t.flag_name, coalesce(p.s = c.s, false) AS same_files
FROM tgt t LEFT JOIN pset p ON p.repo_id = t.repo_id AND p.flag_name = t.flag_name
           LEFT JOIN cset c ON c.repo_id = t.repo_id AND c.flag_name = t.flag_name
UNION ALL SELECT repo_id, 2, flag_name, true FROM tgt2
""")
def set_equality(spark, sf_dir):
    """Proposed file set == candidate file set (sorted, de-duplicated arrays)."""
    _, targets = _parsed(spark, sf_dir)
    key = ["repo_id", "attempt", "flag_name"]
    prop = V.target_files(targets).where(F.col("error_code").isNull()).groupBy(*key).agg(
        F.array_sort(F.collect_set("path")).alias("proposed"))
    c = _candidates(spark, sf_dir).select("repo_id", "flag_name", "files")
    j = targets.select(*key).join(prop, key, "left").join(c, ["repo_id", "flag_name"], "left")
    return j.select(*key, F.coalesce(F.col("proposed") == F.col("files"), F.lit(False)).alias("same_files"))


@query("dup_paths", oracle=_ORACLE_TARGETS + """
SELECT repo_id, flag_name, npath AS path, CAST(count(*) AS BIGINT) AS n FROM good_pf GROUP BY ALL HAVING count(*) > 1
""")
def dup_paths(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    f = V.target_files(targets)
    d = V.dup_paths(f)
    return d.join(f.select(*V.TARGET_KEY, "flag_name").distinct(), V.TARGET_KEY).select(
        "repo_id", "flag_name", "path", F.col("n").cast("bigint").alias("n"))


_ORACLE_EVIDENCE = _ORACLE_TARGETS + f"""
, ctx AS ({CONTEXT_SQL.replace('customer', 'customer')}),
cust AS (SELECT CAST(c_custkey AS STRING) AS repo_id, c_name FROM customer),
ev AS (
  SELECT t.repo_id, t.flag_name, t.ordinal, 1 AS ev_ordinal, 'business_context' AS source,
         CASE WHEN (CAST(t.repo_id AS BIGINT) + length(t.flag_name)) % 5 <> 0 THEN c.c_name ELSE 'words nobody wrote' END AS quote
  FROM tgt t LEFT JOIN cust c ON c.repo_id = t.repo_id
  UNION ALL
  SELECT repo_id, flag_name, ordinal, 2, 'repository', concat('if ', flag_name) FROM tgt
),
repo_text AS (
  SELECT repo_id, flag_name, string_agg(snippet, chr(10) ORDER BY file_path, line, kind, snippet) AS txt
  FROM occ WHERE repo_id NOT IN (SELECT repo_id FROM failed) GROUP BY ALL
),
ungrounded AS (
  SELECT e.* FROM ev e
  LEFT JOIN ctx x ON x.repo_id = e.repo_id
  LEFT JOIN repo_text r ON r.repo_id = e.repo_id AND r.flag_name = e.flag_name
  WHERE NOT coalesce(contains(CASE WHEN e.source = 'business_context' THEN trim(x.text, ' ' || chr(10)) ELSE r.txt END, e.quote), false)
)
"""


@query("join_evidence_grounding", oracle=_ORACLE_EVIDENCE + """
SELECT repo_id, flag_name, CAST(ev_ordinal AS INTEGER) AS ev_ordinal, source, quote FROM ungrounded
""")
def join_evidence_grounding(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    t1 = targets
    return V.join_evidence_grounding(t1, contexts(spark, sf_dir), _candidates(spark, sf_dir)).select(
        "repo_id", "flag_name", "ev_ordinal", "source", "quote")


@query("benchmark_grounding", oracle="""
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)
""")
def benchmark_grounding(spark, sf_dir):
    """Keyless grounding: which benchmark passages occur verbatim in which documents."""
    from flagtide.plans.grounding import quotes_in_texts
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return quotes_in_texts(bench, docs, "item_id", "quote", "doc_id", "text")


_ORACLE_SCHEMA = _ORACLE_TARGETS + """
, schema_bad AS (
  SELECT DISTINCT repo_id FROM pfn GROUP BY repo_id, flag_name, raw_path HAVING count(*) > 1
  UNION SELECT CAST(c_custkey AS STRING) FROM customer WHERE c_custkey % 23 = 0 OR c_custkey % 29 = 0
)
"""


@query("read_plans", oracle=_ORACLE_TARGETS + """
SELECT t.repo_id, 1 AS attempt, t.ordinal, t.flag_name,
       CASE WHEN CAST(t.repo_id AS BIGINT) % 23 = 0 THEN 'STRING' ELSE 'BOOLEAN' END AS final_state_type,
       CAST((SELECT count(*) FROM pf WHERE pf.repo_id = t.repo_id AND pf.flag_name = t.flag_name) AS INTEGER) AS n_files,
       CAST(CASE WHEN CAST(t.repo_id AS BIGINT) % 29 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_extra_keys
FROM tgt t
UNION ALL
SELECT t.repo_id, 2, t.ordinal, t.flag_name, 'BOOLEAN',
       CAST((SELECT count(*) FROM cand_files c WHERE c.repo_id = t.repo_id AND c.flag_name = t.flag_name) AS INTEGER), 0
FROM tgt2 t
""")
def read_plans(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    return targets.select(
        "repo_id", "attempt", "ordinal", "flag_name", "final_state_type",
        F.size("files_affected").alias("n_files"), F.size("extra_keys").alias("n_extra_keys"))


@query("target_rules", oracle=_ORACLE_SCHEMA + """
SELECT repo_id, CAST(count(*) AS BIGINT) AS n_target_violations FROM (
  SELECT repo_id FROM (SELECT DISTINCT repo_id, flag_name FROM pfn GROUP BY repo_id, flag_name, raw_path HAVING count(*) > 1) d
  UNION ALL SELECT repo_id FROM tgt WHERE CAST(repo_id AS BIGINT) % 23 = 0
  UNION ALL SELECT repo_id FROM tgt WHERE CAST(repo_id AS BIGINT) % 29 = 0
) v GROUP BY repo_id
""")
def target_rules(spark, sf_dir):
    _, targets = _parsed(spark, sf_dir)
    v = V.target_rules(targets)
    return v.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_target_violations"))


@query("evidence_rules", oracle="""
WITH d AS (SELECT doc_id, doc_id % 6 AS fault, length(text) AS n,
                  trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank FROM documents)
SELECT doc_id, fault = 1 AS bad_source, n < 1 OR n > 500 OR fault = 5 AS bad_quote,
       fault = 2 OR fault = 3 AS bad_explanation, blank AND n > 0 AND fault <> 5 AS blank_quote,
       fault = 4 AS blank_explanation, fault = 0 AS extra_keys
FROM d
""")
def evidence_rules(spark, sf_dir):
    """Evidence rules on payloads with one document as the quote each; by doc_id %
    6: an extra field, a wrong source, an explanation too long or no string, a
    blank explanation, a quote that is no string."""
    docs = read_table(spark, sf_dir, "documents")
    fault = F.col("doc_id") % 6
    explanation = (F.when(fault == 2, F.lit('"' + "x" * 1001 + '"')).when(fault == 3, F.lit("7"))
                   .when(fault == 4, F.lit('"   "')).otherwise(F.lit('"why"')))
    quoted = F.when(fault == 5, F.lit("12")).otherwise(F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)"))
    payload = F.concat(F.lit('{"targets":[{"flag_name":"A_B","final_state":true,"files_affected":["a.py"],"evidence":[{"source":'),
                       F.when(fault == 1, F.lit('"rumour"')).otherwise(F.lit('"repository"')), F.lit(',"quote":'), quoted,
                       F.lit(',"explanation":'), explanation, F.when(fault == 0, F.lit(',"note":1')).otherwise(F.lit("")),
                       F.lit("}]}]}"))
    attempts = docs.select(F.col("doc_id").cast("string").alias("repo_id"), F.lit(1).alias("attempt"),
                           F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), payload.alias("payload"))
    v = V.evidence_rules(V.parse_plans(attempts)[1])
    rules = {"bad_source": "evidence source", "bad_quote": "quote must", "bad_explanation": "explanation must",
             "blank_quote": "quote cannot", "blank_explanation": "explanation cannot", "extra_keys": "extra evidence"}
    flags = v.groupBy("repo_id").agg(*(F.bool_or(F.col("message").startswith(m)).alias(c) for c, m in rules.items()))
    return docs.select("doc_id").join(flags.withColumn("doc_id", F.col("repo_id").cast("bigint")), "doc_id", "left").select(
        "doc_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in rules))


@query("plan_rules", oracle="""
SELECT CAST(o_custkey AS STRING) AS repo_id, CAST(count(*) > 100 AS BOOLEAN) AS too_many_targets,
       count(*) <> count(DISTINCT o_orderpriority) AS duplicate_flags
FROM orders GROUP BY o_custkey
""")
def plan_rules(spark, sf_dir):
    """Plan rules on plans with one target per order (flag = order priority):
    more than 100 targets, or a repeated flag."""
    orders = read_table(spark, sf_dir, "orders")
    t = orders.select(F.col("o_custkey").cast("string").alias("repo_id"), F.lit(1).alias("attempt"),
                      F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("flag_name"))
    plans = t.groupBy("repo_id", "attempt").agg(F.count(F.lit(1)).alias("n_targets")).select(
        "*", F.lit(True).alias("parsed"), F.array().cast("array<string>").alias("extra_keys"))
    v = V.plan_rules(plans, t)
    agg = v.groupBy("repo_id").agg(
        F.bool_or(F.col("message") == "at most 100 targets").alias("too_many_targets"),
        F.bool_or(F.col("message") == "duplicate target flag").alias("duplicate_flags"))
    return plans.select("repo_id").join(agg, "repo_id", "left").select(
        "repo_id", F.coalesce("too_many_targets", F.lit(False)).alias("too_many_targets"),
        F.coalesce("duplicate_flags", F.lit(False)).alias("duplicate_flags"))


@query("dup_flags", oracle="""
SELECT p_brand AS repo_id, 'duplicate target flag' AS message FROM part GROUP BY p_brand HAVING count(*) > count(DISTINCT p_type)
""")
def dup_flags(spark, sf_dir):
    """The plan rule on one plan per brand with a target per part (flag = part
    type, every other one with blanks around, which the parse strips)."""
    part = read_table(spark, sf_dir, "part")
    flag = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_type", F.lit("\t"))).otherwise(F.col("p_type"))
    plans = part.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(F.struct(flag.alias("flag_name"))).alias("targets")))
                                        .alias("payload"))
    attempts = plans.select(F.col("p_brand").alias("repo_id"), F.lit(1).alias("attempt"), F.lit("completed").alias("status"),
                            F.lit(None).cast("string").alias("error"), "payload")
    p, t = V.parse_plans(materialize(attempts))
    return V.plan_rules(p, t).where(F.col("message") == "duplicate target flag").select("repo_id", "message")


_FIRSTS_SQL = _ORACLE_EVIDENCE + """
, sem AS (
  SELECT repo_id, ordinal, 1 AS rnk, 0 AS evo FROM tgt t
    WHERE NOT EXISTS (SELECT 1 FROM cand_flags c WHERE c.repo_id = t.repo_id AND c.flag_name = t.flag_name)
  UNION ALL SELECT repo_id, ordinal, 2, 0 FROM pfn WHERE error_code IS NOT NULL
  UNION ALL SELECT repo_id, ordinal, 3, 0 FROM good_pf GROUP BY repo_id, ordinal, npath HAVING count(*) > 1
  UNION ALL SELECT repo_id, ordinal, 4, 0 FROM good_pf p
    WHERE NOT EXISTS (SELECT 1 FROM allow a WHERE a.repo_id = p.repo_id AND a.path = p.npath)
  UNION ALL SELECT repo_id, ordinal, 5, 0 FROM good_pf p
    WHERE EXISTS (SELECT 1 FROM allow a WHERE a.repo_id = p.repo_id AND a.path = p.npath)
      AND NOT EXISTS (SELECT 1 FROM cand_files c WHERE c.repo_id = p.repo_id AND c.flag_name = p.flag_name AND c.path = p.npath)
  UNION ALL SELECT t.repo_id, t.ordinal, 6, 0 FROM tgt t JOIN cand_files c ON c.repo_id = t.repo_id AND c.flag_name = t.flag_name
    WHERE NOT EXISTS (SELECT 1 FROM good_pf p WHERE p.repo_id = t.repo_id AND p.flag_name = t.flag_name AND p.npath = c.path)
  UNION ALL SELECT repo_id, ordinal, 7, ev_ordinal FROM ungrounded
),
schema_v AS (
  SELECT repo_id, min(ordinal) AS ordinal FROM (
    SELECT repo_id, ordinal FROM pfn GROUP BY repo_id, ordinal, raw_path HAVING count(*) > 1
    UNION ALL SELECT repo_id, ordinal FROM tgt WHERE CAST(repo_id AS BIGINT) % 23 = 0 OR CAST(repo_id AS BIGINT) % 29 = 0
  ) s GROUP BY repo_id
),
firsts AS (
  SELECT repo_id, CAST(ordinal AS INTEGER) AS ordinal, 'schema' AS rule FROM schema_v
  UNION ALL
  SELECT repo_id, CAST(arg_min(ordinal, ordinal * 100 + rnk * 10 + evo) AS INTEGER),
         CASE arg_min(rnk, ordinal * 100 + rnk * 10 + evo) WHEN 1 THEN 'unknown_flag' WHEN 2 THEN 'bad_path'
              WHEN 3 THEN 'duplicate_path' WHEN 4 THEN 'hallucinated_path' WHEN 5 THEN 'unrelated_path'
              WHEN 6 THEN 'omitted_path' ELSE 'ungrounded_evidence' END
  FROM sem WHERE repo_id NOT IN (SELECT repo_id FROM schema_v) GROUP BY repo_id
)
"""


@query("first_violation", oracle=_FIRSTS_SQL + """
SELECT repo_id, 1 AS attempt, ordinal, rule FROM firsts
""")
def first_violation(spark, sf_dir):
    plans, targets = _parsed(spark, sf_dir)
    p1, t1 = plans, targets
    v = V.all_violations(p1, t1, _candidates(spark, sf_dir), _allowlist(spark, sf_dir), contexts(spark, sf_dir))
    return V.first_violation(v).select("repo_id", "attempt", "ordinal", "rule")


_EVENTS_ATTEMPTS = """
ev AS (
  SELECT user_id, ts, event_id, event_type, CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'signup' THEN 'fatal'
         ELSE 'invalid' END AS outcome, concat('event ', CAST(event_id AS VARCHAR)) AS err
  FROM events
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
top2 AS (SELECT * FROM ranked WHERE n <= 2),
stop AS (SELECT user_id, min(n) AS stop_at FROM top2 WHERE outcome IN ('valid', 'fatal') GROUP BY user_id),
seen AS (SELECT user_id, max(n) AS seen FROM top2 GROUP BY user_id)
"""


@query("resolve_attempts", oracle=f"""
WITH {_EVENTS_ATTEMPTS}
SELECT s.user_id,
       CASE WHEN st.stop_at IS NULL THEN 'exhausted' WHEN t.outcome = 'valid' THEN 'accepted' ELSE 'fatal' END AS resolution,
       CAST(coalesce(st.stop_at, s.seen) AS INTEGER) AS used_attempt, coalesce(t.event_id, l.event_id) AS used_event_id,
       CASE WHEN st.stop_at IS NULL THEN l.err WHEN t.outcome = 'fatal' THEN t.err END AS error
FROM seen s LEFT JOIN stop st ON st.user_id = s.user_id
LEFT JOIN top2 t ON t.user_id = s.user_id AND t.n = st.stop_at
LEFT JOIN top2 l ON l.user_id = s.user_id AND l.n = s.seen
""")
def resolve_attempts(spark, sf_dir):
    """All events per user as model attempts: purchase = valid plan, signup =
    fatal, any other = rule violation (retry); at most 2 attempts."""
    ev = read_table(spark, sf_dir, "events").select(
                   "user_id", "ts", "event_id",
                   F.when(F.col("event_type") == "purchase", "valid").when(F.col("event_type") == "signup", "fatal")
                   .otherwise("invalid").alias("outcome"),
                   F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("err"))
    return V.resolve_attempts(ev, "user_id", ["ts", "event_id"], "outcome", "err", max_attempts=2).select(
        "user_id", "resolution", F.col("attempts_used").alias("used_attempt"), "used_event_id", "error")


@query("plan_resolution", oracle=_FIRSTS_SQL + """
, att AS (
  SELECT repo_id, 1 AS attempt,
         CASE WHEN CAST(repo_id AS BIGINT) % 31 = 0 THEN 'fatal'
              WHEN repo_id IN (SELECT repo_id FROM firsts) THEN 'invalid' ELSE 'valid' END AS outcome
  FROM (SELECT DISTINCT repo_id FROM proposal) p
  UNION ALL SELECT DISTINCT repo_id, 2, 'valid' FROM cand WHERE CAST(repo_id AS BIGINT) % 3 = 0
),
rk AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY attempt) AS n FROM att),
top2 AS (SELECT * FROM rk WHERE n <= 2),
agg AS (SELECT repo_id, min(CASE WHEN outcome IN ('valid', 'fatal') THEN attempt END) AS stop_at, max(attempt) AS seen
        FROM top2 GROUP BY repo_id)
SELECT a.repo_id,
       CASE WHEN a.stop_at IS NULL THEN 'exhausted' WHEN t.outcome = 'valid' THEN 'accepted' ELSE 'fatal' END AS resolution,
       CAST(coalesce(a.stop_at, a.seen) AS INTEGER) AS used_attempt
FROM agg a LEFT JOIN top2 t ON t.repo_id = a.repo_id AND t.attempt = a.stop_at
""")
def plan_resolution(spark, sf_dir):
    """Full plan check per attempt, then first-success-per-repo over attempts."""
    from flagtide.plans.discovery import discover_plans
    return discover_plans(plan_attempts(spark, sf_dir), _candidates(spark, sf_dir),
                          _allowlist(spark, sf_dir), contexts(spark, sf_dir)).select(
        "repo_id", "resolution", "used_attempt")


@query("early_exit_rules", oracle=f"""
WITH corpus AS ({CORPUS_SQL}),
failed AS (SELECT DISTINCT repo_id FROM corpus WHERE o_orderkey % 97 = 0),
ncand AS (SELECT repo_id, count(*) AS n FROM corpus WHERE k IN (0, 1, 2, 5, 7) AND o_orderkey % 97 <> 0
          AND repo_id NOT IN (SELECT repo_id FROM failed) GROUP BY repo_id),
ctx AS (SELECT CAST(c_custkey AS STRING) AS repo_id,
               CASE WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 17 = 0 THEN concat(' ', repeat(c_name, 1200), ' ')
                    ELSE concat(c_name, ' ', c_mktsegment) END AS text FROM customer)
SELECT c.repo_id,
       CASE WHEN length(trim(c.text)) > 20000 THEN 'error_context_too_long'
            WHEN trim(c.text) = '' THEN 'empty_plan_no_context'
            WHEN n.n IS NULL THEN 'empty_plan_no_candidates'
            WHEN CAST(c.repo_id AS BIGINT) % 7 = 0 THEN 'error_empty_allowlist'
            ELSE 'call_model' END AS decision
FROM ctx c LEFT JOIN ncand n ON n.repo_id = c.repo_id
""")
def early_exit_rules(spark, sf_dir):
    """Decision per repo before any model call: the context is blank for customers
    % 11 and too long for % 17, the allowlist is empty for % 7."""
    from flagtide.plans.discovery import early_exit
    cust = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    ctx = cust.select(key.cast("string").alias("repo_id"),
                      F.when(key % 11 == 0, F.lit("   "))
                      .when(key % 17 == 0, F.concat(F.lit(" "), F.repeat("c_name", F.lit(1200)), F.lit(" ")))
                      .otherwise(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("text"))
    allow = _allowlist(spark, sf_dir).where(F.col("repo_id").cast("bigint") % 7 != 0)
    return early_exit(ctx, _candidates(spark, sf_dir), allow).select("repo_id", "decision")


@query("prompt_table", oracle=_ORACLE_EVIDENCE + """
, c_ok AS (SELECT * FROM occ WHERE repo_id NOT IN (SELECT repo_id FROM failed)),
fl AS (SELECT repo_id, flag_name, string_agg(concat('- ', path), chr(10) ORDER BY path) AS files_txt
       FROM (SELECT DISTINCT repo_id, flag_name, file_path AS path FROM c_ok) x GROUP BY ALL),
oc AS (SELECT repo_id, flag_name,
              string_agg(concat(file_path, ':', CAST(line AS VARCHAR), ' (', kind, ')', chr(10), snippet),
                         chr(10) || chr(10) ORDER BY file_path, line, kind, snippet) AS occ_txt
       FROM c_ok GROUP BY ALL),
blocks AS (SELECT f.repo_id, f.flag_name,
                  concat('FLAG ', f.flag_name, chr(10), 'REQUIRED FILES:', chr(10), f.files_txt, chr(10),
                         'OCCURRENCES:', chr(10), o.occ_txt) AS block
           FROM fl f JOIN oc o ON o.repo_id = f.repo_id AND o.flag_name = f.flag_name),
prompts AS (SELECT b.repo_id, concat('BUSINESS CONTEXT:', chr(10), coalesce(trim(max(x.text), ' ' || chr(10)), ''),
                                     chr(10), chr(10), 'CANDIDATES:', chr(10),
                                     string_agg(b.block, chr(10) || chr(10) ORDER BY b.flag_name), $rules) AS prompt
            FROM blocks b LEFT JOIN ctx x ON x.repo_id = b.repo_id
            WHERE CAST(b.repo_id AS BIGINT) % 11 <> 0 GROUP BY b.repo_id),
turns AS (SELECT repo_id, 1 AS attempt, prompt FROM prompts
          UNION ALL SELECT repo_id, 2, concat(prompt, $head, 'rule ', CAST(CAST(repo_id AS BIGINT) % 4 AS VARCHAR), $tail) FROM prompts
          WHERE CAST(repo_id AS BIGINT) % 4 <> 0)
SELECT repo_id, attempt, CASE WHEN length(prompt) <= 80000 THEN prompt END AS prompt,
       CAST(length(prompt) AS BIGINT) AS prompt_chars, length(prompt) > 80000 AS too_long FROM turns
""".replace("$rules", _literal(PROMPT_RULES)).replace("$head", _literal(RETRY_HEAD)).replace("$tail", _literal(RETRY_TAIL)))
def prompt_table(spark, sf_dir):
    """Prompts in full, for the first attempt and (where it was rejected) the
    second; repositories with a blank context (customers % 11) are not asked."""
    from flagtide.plans.discovery import prompt_table as build

    rid = F.col("repo_id").cast("bigint")
    ctx = contexts(spark, sf_dir).withColumn("text", F.when(rid % 11 == 0, F.lit(" \t")).otherwise(F.col("text")))
    rejected = ctx.where(rid % 4 != 0).select("repo_id", F.lit(1).alias("attempt"), F.concat(
        F.lit("rule "), (rid % 4).cast("string")).alias("error"))
    return build(_candidates(spark, sf_dir), ctx, allowlist=_allowlist(spark, sf_dir), rejections=rejected)


@query("candidate_checks", oracle=_ORACLE_TARGETS + """
SELECT repo_id, flag_name, concat('file outside the allowlist: ', path) AS message FROM cand_files WHERE length(path) % 3 = 0
UNION SELECT repo_id, flag_name, 'candidate listed twice' FROM cand_flags WHERE length(flag_name) % 2 = 0
""")
def candidate_checks(spark, sf_dir):
    """Candidates against an allowlist that lacks paths of some lengths, with the
    flags of even length listed twice."""
    from flagtide.plans.discovery import check_candidates

    c = _candidates(spark, sf_dir)
    twice = c.unionByName(c.where(F.length("flag_name") % 2 == 0))
    return check_candidates(twice, _allowlist(spark, sf_dir).where(F.length("path") % 3 != 0))
