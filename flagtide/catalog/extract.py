"""Scan, decode and guard-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flagtide.functions import text as tx
from flagtide.operators import guards as G
from flagtide.registry import query
from flagtide.session import materialize
from flagtide.sources.tables import CORPUS_SQL, generated_source_files, read_table, shared_sql

# Directory trees planted from order columns: ignored, hidden and normal
# folders, hidden files, upper-case suffixes. Same SQL in Spark and DuckDB.
PATHS_SQL = """
SELECT CAST(o_custkey AS STRING) AS repo_id, o_orderkey,
       concat(CASE o_orderkey % 9 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/.cache/' WHEN 2 THEN 'a/build/'
                                  WHEN 3 THEN '' WHEN 4 THEN 'lib/' WHEN 5 THEN 'pkg/__pycache__/'
                                  WHEN 6 THEN 'app/.hidden_dir/x/' WHEN 7 THEN 'node_modules/m/'
                                  ELSE 'core/testsuite/' END,
              CASE o_orderkey % 4 WHEN 0 THEN '__init__.py'
                                  WHEN 1 THEN concat('.mod_', CAST(o_orderkey AS STRING), '.py')
                                  WHEN 2 THEN concat('mod_', CAST(o_orderkey AS STRING), '.PY')
                                  ELSE concat('mod_', CAST(o_orderkey AS STRING), '.py') END) AS path
FROM orders
"""

# Expected guards per template (line, end line, kind); see FIXTURES.md.
PLANTED_GUARDS_SQL = f"""
corpus AS ({CORPUS_SQL}),
good AS (SELECT * FROM corpus WHERE o_orderkey % 97 <> 0),
planted AS (
  SELECT repo_id, flag AS flag_name, path AS file_path, 2 AS line, 5 AS end_line, 'if_statement' AS kind, source FROM good WHERE k = 0
  UNION ALL SELECT repo_id, flag, path, 1, 1, 'ternary_expression', source FROM good WHERE k = 1
  UNION ALL SELECT repo_id, flag, path, 3, 6, 'if_statement', source FROM good WHERE k = 2
  UNION ALL SELECT repo_id, flag, path, 1, 3, 'if_statement', source FROM good WHERE k = 5
  UNION ALL SELECT repo_id, flag, path, 2, 3, 'if_statement', source FROM good WHERE k = 5
  UNION ALL SELECT repo_id, flag, path, 2, 3, 'if_statement', source FROM good WHERE k = 7
),
split AS (
  SELECT *, string_split(replace(source, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM planted
),
occ AS (
  SELECT repo_id, flag_name, file_path, line, kind,
         array_to_string(list_transform(
             list_slice(ls, greatest(1, line - 2), least(len(ls) - 1, end_line + 2)),
             lambda x, i: printf('%4d: %s', greatest(1, line - 2) + i - 1, x)), chr(10)) AS snippet
  FROM split
),
failed AS (SELECT DISTINCT repo_id FROM corpus WHERE o_orderkey % 97 = 0)
"""

WS = tx.WS_CLASS


def _files(spark, sf_dir):
    return generated_source_files(spark, sf_dir)


def _paths(spark, sf_dir):
    return shared_sql(spark, PATHS_SQL, sf_dir)


@query("scan_sources", oracle=f"""
WITH p AS ({PATHS_SQL})
SELECT repo_id, path FROM p WHERE o_orderkey % 9 IN (3, 4, 8) AND o_orderkey % 4 <> 2
""")
def scan_sources(spark, sf_dir):
    return G.prune_ignored(_paths(spark, sf_dir)).select("repo_id", "path")


@query("path_allowlist", oracle=f"""
WITH p AS ({PATHS_SQL})
SELECT DISTINCT repo_id, path FROM p WHERE o_orderkey % 9 IN (3, 4, 8) AND o_orderkey % 4 <> 2
""")
def path_allowlist(spark, sf_dir):
    """Every path in two spellings (as scanned, and with back-slashes and
    blanks around); the operator makes one row of them."""
    paths = G.prune_ignored(_paths(spark, sf_dir)).select("repo_id", "path")
    other = F.concat(F.lit(" "), F.translate("path", "/", "\\"), F.lit("\t"))
    allow = G.path_allowlist(paths.unionByName(paths.select("repo_id", other.alias("path"))))
    return allow.where(F.col("error_code").isNull()).select("repo_id", "path")


@query("size_guard", oracle="""
SELECT CAST(doc_id AS VARCHAR) AS path, 'file is ' || strlen(text) || ' bytes; limit is 4096' AS error
FROM documents WHERE strlen(text) > 4096
""")
def size_guard(spark, sf_dir):
    """The extractor's ``oversize`` stage on documents as files, limit 4,096 bytes."""
    docs = read_table(spark, sf_dir, "documents")
    files = docs.select(F.lit("r").alias("repo_id"), F.col("doc_id").cast("string").alias("path"),
                        F.lit(None).cast("bigint").alias("size"), F.encode("text", "UTF-8").alias("content"))
    return G.extract_files(files, max_file_bytes=4096).where(F.col("stage") == "oversize").select("path", "error")


def _doc_bytes(spark, sf_dir):
    """documents as raw bytes: every 5th gets a BOM, every 7th an invalid byte."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    enc = F.encode("text", "UTF-8")
    content = (F.when(F.col("doc_id") % 7 == 0, F.concat(enc, F.lit(b"\xff")))
               .when(F.col("doc_id") % 5 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), enc))
               .otherwise(enc))
    return docs.select("doc_id", content.alias("content"))


@query("decode_source", oracle="""
SELECT doc_id,
       doc_id % 7 <> 0 AND doc_id % 5 = 0 AS had_bom,
       CASE WHEN doc_id % 7 = 0 THEN 'invalid UTF-8' END AS decode_error,
       CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS text_sha256
FROM documents
""")
def decode_source(spark, sf_dir):
    d = G.decode_source(_doc_bytes(spark, sf_dir))
    return d.select("doc_id", "had_bom", "decode_error", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query("encode_source", oracle="""
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(strlen(text) + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS BIGINT) END AS n_bytes,
       CASE WHEN doc_id % 7 <> 0 THEN true END AS round_trip
FROM documents
""")
def encode_source(spark, sf_dir):
    """Every document back to bytes; null where the bytes were no UTF-8."""
    d = G.decode_source(_doc_bytes(spark, sf_dir))
    back = G.encode_source("text", "had_bom")
    return d.select("doc_id", F.length(back).cast("bigint").alias("n_bytes"), (back == F.col("content")).alias("round_trip"))


_FLAG_FEED = """
SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS candidate FROM part
UNION ALL SELECT p_partkey, p_type FROM part
UNION ALL SELECT p_partkey, p_name FROM part
UNION ALL SELECT p_partkey, concat(upper(replace(p_name, ' ', '_')), '_', CAST(p_size AS STRING)) FROM part
UNION ALL SELECT p_partkey, concat('_', upper(p_type)) FROM part
UNION ALL SELECT p_partkey, concat(upper(replace(p_name, ' ', '_')), '_') FROM part
"""


@query("is_flag_name", oracle=f"""
WITH f AS ({_FLAG_FEED})
SELECT p_partkey, candidate, regexp_full_match(candidate, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)+') AS is_flag FROM f
""")
def is_flag_name(spark, sf_dir):
    return shared_sql(spark, _FLAG_FEED, sf_dir, ["part"]).select("p_partkey", "candidate", tx.is_flag_name("candidate").alias("is_flag"))


@query("extract_guards", oracle=f"""
WITH {PLANTED_GUARDS_SQL}
SELECT repo_id, flag_name, file_path, line, kind, snippet FROM occ
""")
def extract_guards(spark, sf_dir):
    return G.extract(_files(spark, sf_dir)).occurrences


@query("parse_errors", oracle=f"""
WITH corpus AS ({CORPUS_SQL})
SELECT repo_id, path, 'parse' AS stage FROM corpus WHERE o_orderkey % 97 = 0
""")
def parse_errors(spark, sf_dir):
    return G.extract(_files(spark, sf_dir)).errors.select("repo_id", "path", "stage")


@query("guard_snippet", oracle=f"""
WITH d AS (
  SELECT doc_id, ls, len(ls) AS n, (doc_id * 7) % len(ls) + 1 AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM documents WHERE text <> '')
), s AS (
  SELECT doc_id, array_to_string(list_transform(list_slice(ls, greatest(1, line - 2), least(n, line + 2)),
             lambda x, i: printf('%4d: %s', greatest(1, line - 2) + i - 1, x)), chr(10)) AS snip
  FROM d
)
SELECT doc_id, CASE WHEN length(snip) <= 2000 THEN snip
                    ELSE regexp_replace(left(snip, 1976), '{WS}+\\z', '') || chr(10) || '... [snippet truncated]' END AS snippet
FROM s
""")
def guard_snippet(spark, sf_dir):
    """Snippet around one line of each document (documents as source files)."""
    docs = read_table(spark, sf_dir, "documents").where(F.col("text") != "")
    lines = tx.split_lines("text")
    line = (F.col("doc_id") * 7) % F.size(lines) + 1
    return docs.select("doc_id", tx.guard_snippet(lines, line, line).alias("snippet"))


@query("truncate_snippet", oracle=f"""
SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text
                    ELSE regexp_replace(left(text, 1976), '{WS}+\\z', '') || chr(10) || '... [snippet truncated]' END AS out
FROM documents
""")
def truncate_snippet(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.truncate_snippet("text").alias("out"))


@query("truncate_output", oracle=f"""
SELECT doc_id, CASE WHEN length(t) <= 50000 THEN t
                    ELSE regexp_replace(left(t, 50000), '{WS}+\\z', '') || chr(10) || '... [truncated '
                         || CAST(length(t) - 50000 AS VARCHAR) || ' character(s)]' END AS out
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN repeat(concat(text, '    ', chr(10)), CAST(1 + 60000 // (length(text) + 1) AS INTEGER))
                          ELSE text END AS t FROM documents)
""")
def truncate_output(spark, sf_dir):
    """Every text as the output of a run; every fifth one repeated to beyond the limit."""
    docs = read_table(spark, sf_dir, "documents")
    long = F.repeat(F.concat("text", F.lit("    \n")), (1 + F.floor(F.lit(60000) / (F.length("text") + 1))).cast("int"))
    return docs.select("doc_id", tx.truncate_output(F.when(F.col("doc_id") % 5 == 0, long).otherwise(F.col("text"))).alias("out"))


_CAND_ORACLE = f"""
WITH {PLANTED_GUARDS_SQL},
cand AS (
  SELECT repo_id, flag_name, CAST(count(*) AS BIGINT) AS n_occurrences,
         string_agg(concat_ws('|', file_path, CAST(line AS VARCHAR), kind, snippet), chr(10)
                    ORDER BY file_path, line, kind, snippet) AS occurrences,
         CAST(count(DISTINCT file_path) AS BIGINT) AS n_files,
         string_agg(DISTINCT file_path, ',' ORDER BY file_path) AS files
  FROM occ WHERE repo_id NOT IN (SELECT repo_id FROM failed)
  GROUP BY repo_id, flag_name
)
"""


# Candidates are checkpointed once per query run and shared by its parts.
_MEMO: dict = {}


def reset_memo() -> None:
    _MEMO.clear()


def _candidates(spark, sf_dir, limit=G.MAX_OCCURRENCES_PER_FLAG):
    key = (spark.sparkContext.applicationId, sf_dir, limit)
    if key not in _MEMO:
        _MEMO[key] = materialize(G.discover_candidates(_files(spark, sf_dir), limit=limit)[0])
    return _MEMO[key]


def _occ_text():
    return F.array_join(F.transform("occurrences", lambda o: F.concat_ws(
        "|", o["file_path"], o["line"].cast("string"), o["kind"], o["snippet"])), "\n")


@query("group_candidates", oracle=_CAND_ORACLE + """
SELECT repo_id, flag_name, n_occurrences, occurrences FROM cand
""")
def group_candidates(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("repo_id", "flag_name", "n_occurrences", _occ_text().alias("occurrences"))


@query("sort_occurrences", oracle=_CAND_ORACLE + """
SELECT repo_id, flag_name, occurrences FROM cand
""")
def sort_occurrences(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("repo_id", "flag_name", _occ_text().alias("occurrences"))


@query("candidate_files", oracle=_CAND_ORACLE + """
SELECT repo_id, flag_name, n_files, files FROM cand
""")
def candidate_files(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("repo_id", "flag_name", F.size("files").cast("bigint").alias("n_files"),
                    F.array_join("files", ",").alias("files"))


@query("sort_files", oracle=f"""
WITH {PLANTED_GUARDS_SQL}
SELECT DISTINCT repo_id, file_path FROM occ WHERE repo_id NOT IN (SELECT repo_id FROM failed)
""")
def sort_files(spark, sf_dir):
    """Guarded files of every repo, de-duplicated and sorted by (repo, path).

    A range-partitioned global sort: a repository with a third of all files
    is split over several sort tasks by path instead of landing in one list.
    """
    c = _candidates(spark, sf_dir)
    files = c.select("repo_id", F.explode("files").alias("file_path")).dropDuplicates()
    return files.orderBy("repo_id", "file_path")


@query("dedupe_files", oracle=f"""
WITH {PLANTED_GUARDS_SQL}
SELECT DISTINCT repo_id, file_path FROM occ
""")
def dedupe_files(spark, sf_dir):
    return G.extract(_files(spark, sf_dir)).occurrences.select("repo_id", "file_path").dropDuplicates()


@query("occurrence_limit", oracle=f"""
WITH {PLANTED_GUARDS_SQL}
SELECT repo_id, flag_name, CAST(count(*) AS BIGINT) AS n_occurrences
FROM occ GROUP BY repo_id, flag_name HAVING count(*) > 1
""")
def occurrence_limit(spark, sf_dir):
    """(repo, flag) groups over a limit of 1 occurrence."""
    occ = G.extract(_files(spark, sf_dir)).occurrences
    return G.occurrence_limit(occ, limit=1)


@query("strict_failed_repos", oracle=f"""
WITH {PLANTED_GUARDS_SQL}
SELECT repo_id FROM failed
UNION SELECT repo_id FROM occ GROUP BY repo_id, flag_name HAVING count(*) > 3
""")
def strict_failed_repos(spark, sf_dir):
    """Repos failed as a whole: a bad file or a flag over a limit of 3."""
    ex = G.extraction_of(materialize(G.extract_files(_files(spark, sf_dir))))  # parsed once for both uses
    return G.failed_repos(ex.errors, ex.occurrences, limit=3)


@query("top_flags", oracle=f"""
WITH {PLANTED_GUARDS_SQL}
SELECT flag_name, CAST(count(DISTINCT repo_id) AS BIGINT) AS n_repos,
       CAST(count(DISTINCT concat_ws('|', repo_id, file_path)) AS BIGINT) AS n_files, CAST(count(*) AS BIGINT) AS n_occurrences
FROM occ GROUP BY flag_name ORDER BY n_repos DESC, n_files DESC, flag_name LIMIT 20
""")
def top_flags(spark, sf_dir):
    return G.top_flags(G.extract(_files(spark, sf_dir)).occurrences, 20)


@query("used_names", oracle=f"""
WITH corpus AS ({CORPUS_SQL}),
good AS (SELECT * FROM corpus WHERE o_orderkey % 97 <> 0),
names AS (
  SELECT repo_id, path, flag AS name FROM good WHERE k IN (0, 1, 2, 3, 5, 7)
  UNION ALL SELECT repo_id, path, 'new_f' FROM good WHERE k = 0
  UNION ALL SELECT repo_id, path, 'old_f' FROM good WHERE k = 0
  UNION ALL SELECT repo_id, path, 'h' FROM good WHERE k = 1
  UNION ALL SELECT repo_id, path, 'new_h' FROM good WHERE k = 1
  UNION ALL SELECT repo_id, path, 'old_h' FROM good WHERE k = 1
  UNION ALL SELECT repo_id, path, 'OTHER' FROM good WHERE k = 2
  UNION ALL SELECT repo_id, path, 'a' FROM good WHERE k IN (2, 5, 7)
  UNION ALL SELECT repo_id, path, 'b' FROM good WHERE k = 2
  UNION ALL SELECT repo_id, path, 'c' FROM good WHERE k = 2
  UNION ALL SELECT repo_id, path, 'ok' FROM good WHERE k = 3
  UNION ALL SELECT repo_id, path, 'x' FROM good WHERE k IN (3, 4)
  UNION ALL SELECT repo_id, path, 'enabled' FROM good WHERE k = 4
  UNION ALL SELECT repo_id, path, 's' FROM good WHERE k = 6
  UNION ALL SELECT repo_id, path, 'f' FROM good WHERE k = 7
)
SELECT repo_id, path, name FROM names
""")
def used_names(spark, sf_dir):
    from flagtide.operators.rewrite import used_names_table
    return used_names_table(_files(spark, sf_dir))


@query("discovery_audit", oracle=_CAND_ORACLE + """
SELECT repo_id, 'candidate' AS kind, flag_name AS name, n_files FROM cand
UNION ALL
SELECT DISTINCT repo_id, 'allowlist', path, CAST(1 AS BIGINT) FROM corpus
""")
def discovery_audit(spark, sf_dir):
    """What discovery worked with, as rows (a repository with very many flags or
    files never becomes one long list): its candidate flags with their number
    of files, and its allowlist."""
    c = _candidates(spark, sf_dir).select("repo_id", F.lit("candidate").alias("kind"), F.col("flag_name").alias("name"),
                                          F.size("files").cast("bigint").alias("n_files"))
    allow = G.path_allowlist(_files(spark, sf_dir)).where(F.col("error_code").isNull())
    return c.unionByName(allow.select("repo_id", F.lit("allowlist").alias("kind"), F.col("path").alias("name"),
                                      F.lit(1).cast("bigint").alias("n_files")))


_TREE_SQL = f"""
WITH corpus AS ({CORPUS_SQL})
SELECT repo_id, path, CAST(strlen(source) AS BIGINT) AS size, sha256(source) AS sha256 FROM corpus
"""


def _through_trees(spark, sf_dir, read):
    """The corpus written as one folder per repository below the shared checkpoint
    folder (which must be mounted by all machines), a bounded number of files at a time."""
    import uuid

    from flagtide.operators.report import output_root
    from flagtide.sources import tree

    root = output_root(spark) + f"/trees/{uuid.uuid4().hex}"
    return tree.through_trees(_files(spark, sf_dir), root, read)


@query("scan_tree", oracle=_TREE_SQL)
def scan_tree(spark, sf_dir):
    """The corpus as folders, listed by jobs and read."""
    from flagtide.sources import tree

    return _through_trees(spark, sf_dir, lambda root: tree.read_tree(spark, root).select(
        "repo_id", "path", "size", F.sha2("content", 256).alias("sha256")))


@query("tree_source", oracle=_TREE_SQL + " WHERE ends_with(path, '1.py') AND strlen(source) < 60")
def tree_source(spark, sf_dir):
    """The same folders through the data source, with filters it takes over."""
    from flagtide.sources import tree

    tree.register(spark)
    return _through_trees(spark, sf_dir, lambda root: spark.read.format(tree.FORMAT).load(root).where(
        F.col("path").endswith("1.py") & (F.col("size") < 60)).select(
        "repo_id", "path", "size", F.sha2("content", 256).alias("sha256")))
