"""Readers for the driver tables and the generated Python corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# One Python file per order: repo = customer, flag from priority and status,
# template chosen by o_orderkey % 8, every 97th file broken on purpose. The
# same text runs in Spark SQL and in DuckDB, so expected answers can be
# computed from the order columns alone.
CORPUS_SQL = """
SELECT CAST(o_custkey AS STRING) AS repo_id,
       concat('pkg', CAST(o_orderkey % 7 AS STRING), '/mod_', CAST(o_orderkey AS STRING), '.py') AS path,
       flag,
       k,
       o_orderkey,
       CASE WHEN o_orderkey % 97 = 0 THEN concat('if:', chr(10))
            WHEN k = 0 THEN concat('from svc import new_f, old_f', chr(10), 'if ', flag, ':', chr(10), '    new_f()', chr(10), 'else:', chr(10), '    old_f()', chr(10))
            WHEN k = 1 THEN concat('h = new_h if ', flag, ' else old_h', chr(10))
            WHEN k = 2 THEN concat('if OTHER:', chr(10), '    a()', chr(10), 'elif ', flag, ':', chr(10), '    b()', chr(10), 'else:', chr(10), '    c()', chr(10))
            WHEN k = 3 THEN concat('if ', flag, ' and ok:', chr(10), '    x()', chr(10))
            WHEN k = 4 THEN concat('if enabled:', chr(10), '    x()', chr(10))
            WHEN k = 5 THEN concat('if ', flag, ':', chr(10), '    if ', flag, ':', chr(10), '        a()', chr(10))
            WHEN k = 6 THEN concat('# if ', flag, ':', chr(10), 's = "if ', flag, ':"', chr(10))
            ELSE concat('def f():', chr(13), chr(10), '    if ', flag, ':', chr(13), chr(10), '        a()', chr(13), chr(10))
       END AS source
FROM (SELECT *, o_orderkey % 8 AS k,
             concat('ENABLE_', replace(substr(o_orderpriority, 3), ' ', '_'), '_', o_orderstatus) AS flag
      FROM orders) o
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_sql(spark: SparkSession, sql: str, sf_dir: str, tables=("orders",)) -> DataFrame:
    """Run SQL written against the driver table names (the same text DuckDB
    runs) without touching the caller's views: each named table is bound as a
    CTE over a private temp view of its parquet file; Catalyst still prunes
    columns and pushes filters into the scan."""
    import hashlib

    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    ctes = []
    for name in tables:
        view = f"_flagtide_{name}_{tag}"
        read_table(spark, sf_dir, name).createOrReplaceTempView(view)
        ctes.append(f"{name} AS (SELECT * FROM {view})")
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return spark.sql("WITH " + ", ".join(ctes) + ", " + body[4:].lstrip())
    return spark.sql("WITH " + ", ".join(ctes) + " " + body)


def generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo_id, path, flag, k, o_orderkey, source)`` from ``orders``."""
    return shared_sql(spark, CORPUS_SQL, sf_dir)


def generated_source_files(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """The corpus as a ``source_files`` table: ``(repo_id, path, size, content)``.

    ``spread``: files lie over the cluster like a table written in many files;
    operators that deal them out themselves need no such shuffle before."""
    corpus = generated_corpus(spark, sf_dir)
    if spread:
        corpus = corpus.repartition(max(8, 2 * spark.sparkContext.defaultParallelism))
    content = F.encode(F.col("source"), "UTF-8")
    return corpus.select("repo_id", "path", F.length(content).cast("bigint").alias("size"),
                         content.alias("content"))
