"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flagtide.llm import (
    decontaminate, embedding_dedup, exact_dedup, lexical_search, line_dedup, lm_score, minhash, packing,
    sentencepiece_viterbi, suffix_dedup, toxicity, vector_codes, warc)
from flagtide.llm.common import table
from flagtide.llm.registry import query

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


@query("op7_exact_dedup", EXACT_DEDUP_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


# DuckDB has SHA-1 in hexadecimal and base64 but no base32: five bits at a time
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(hex || '0000', 1 + CAST(i * 5 // 4 AS INTEGER), 2))::INTEGER
         >> CAST(3 - (i * 5) % 4 AS INTEGER)) % 32, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM w
"""


@query("op5_warc", WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


# all pairs of sets that share a shingle, and the smallest id over paths of links
MINHASH_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
         GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(l.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


@query("op6_minhash_inverted_join", MINHASH_SQL)
def op6_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(words=3, least=85)).select(
        "doc_id", "n_shingles", "component_id", "kept")


# every string of 200 bytes counted; covered ranges joined, the rest put together again
SUFFIX_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, unnest(range(1, n - 198)) AS p, t FROM b WHERE n >= 200),
strings AS (SELECT doc_id, p, md5(t[p:p + 199]) AS h FROM starts),
again AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM strings WHERE h IN (SELECT h FROM again)),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS opens FROM hit),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 199 AS z FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM runs
         UNION ALL SELECT r.doc_id, max(r.z) + 1, max(b.n) FROM runs r JOIN b ON b.doc_id = r.doc_id GROUP BY r.doc_id),
kept AS (SELECT g.doc_id, unhex(string_agg(hex(b.t[g.a:g.z]), '' ORDER BY g.a)) AS k
         FROM gaps g JOIN b ON b.doc_id = g.doc_id WHERE g.z >= g.a GROUP BY g.doc_id),
cut AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, coalesce(c.spans, 0) AS n_spans,
       sha256(CASE WHEN c.doc_id IS NULL THEN b.t ELSE coalesce(k.k, ''::BLOB) END) AS kept_sha256
FROM b LEFT JOIN cut c ON c.doc_id = b.doc_id LEFT JOIN kept k ON k.doc_id = b.doc_id
"""


@query("op1_suffix_dedup", SUFFIX_SQL)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


EMBEDDING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(l.m, e.vec_id)) = e.vec_id AS kept
FROM e LEFT JOIN degree d ON d.vec_id = e.vec_id LEFT JOIN least l ON l.vec_id = e.vec_id
"""


@query("op2_embedding_collisions", EMBEDDING_SQL)
def op2_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "kept_sha256")


@query("op4_sentencepiece_viterbi")
def op4_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"), with_ids=False)


@query("op9_pseudo_likelihood")
def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


def _codes_sql() -> str:
    """Plain squared distances to every entry; three assignments, two moves."""
    assigned = """
near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 64 + entry) % 64 AS entry, min(d) AS d FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d
    FROM parts c JOIN book{r} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY ALL)"""
    moved = """
sums{r} AS (SELECT c.part, n.entry, c.pos, CAST(sum(c.v) AS BIGINT) AS s, count(*) AS k
  FROM parts c JOIN near{r} n ON n.vec_id = c.vec_id AND n.part = c.part GROUP BY ALL),
book{next} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((s.s - ((s.s % s.k) + s.k) % s.k) // s.k, b.v) AS v
  FROM book{r} b LEFT JOIN sums{r} s ON s.part = b.part AND s.entry = b.entry AND s.pos = b.pos)"""
    steps = [assigned.format(r=0)]
    for r in (0, 1):
        steps += [moved.format(r=r, next=r + 1), assigned.format(r=r + 1)]
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kept AS (SELECT vec_id, label, v FROM e
         WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, len(v) // 16 AS w, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM kept),
parts AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS pos, CAST(floor(256 * x) AS BIGINT) AS v FROM flat),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
book0 AS MATERIALIZED (SELECT p.part, f.entry, p.pos, p.v FROM parts p JOIN first f ON f.vec_id = p.vec_id),{",".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM near2 GROUP BY vec_id)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM kept k JOIN codes c ON c.vec_id = k.vec_id
"""


@query("op11_walsh_codes", _codes_sql())
def op11_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def _words_sql(name: str, key: str) -> str:
    return (f"SELECT {key}, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w "
            f"FROM {name}")


# every window of the items' lengths in every document, compared as text
CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(w, []) AS w FROM ({_words_sql("documents", "doc_id")})),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM ({_words_sql("benchmark", "item_id")}) WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
           FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
sizes AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, n, p FROM places JOIN wanted USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""


@query("op12_wu_manber", CONTAMINATION_SQL)
def op12_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, w FROM ({_words_sql("documents", "doc_id")}) WHERE len(w) > 0),
q AS (SELECT item_id, unnest(w) AS t FROM ({_words_sql("benchmark", "item_id")})),
terms AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
posted AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d)
           WHERE t IN (SELECT t FROM terms) GROUP BY doc_id, len(w), t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM posted, totals GROUP BY t),
parts AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS part
          FROM posted, totals),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * part) AS BIGINT) AS score
           FROM terms JOIN weights USING (t) JOIN parts USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query("op13_presence_masks", SEARCH_SQL)
def op13_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
