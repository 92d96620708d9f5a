"""Exact deduplication with streaming state on disk.

Documents are reduced to fingerprints (digest of the normalised text, stable
id, content locator). A Structured Streaming query folds the fingerprints
into one state entry per digest, kept by RocksDB in the shared checkpoint
folder without any expiry: later batches of documents can be folded into the
same state. The state table is then read back, and every hit (a digest seen
more than once) is checked on the full text bytes before it counts.

DataFrame functions only; no Python code runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flagtide.llm.common import ascii_lower, key_filter, settings, shared_folder, without_rows, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest=sha256_digest) -> DataFrame:
    """doc_id, digest, locator (the file the row was read from, may be empty) and
    row_key (see ``row_key``)."""
    return docs.select(F.col(id_col).alias("doc_id"), digest(ascii_lower(F.col(text_col))).alias("digest"),
                       F.input_file_name().alias("locator"), row_key(id_col, text_col).alias("row_key"))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells apart rows that repeat an id with another text."""
    return F.xxhash64(F.col(id_col), ascii_lower(F.col(text_col)))


def fold(spark: SparkSession, fingerprint_path: str, state_path: str) -> None:
    """Folds all fingerprint files not folded before into the keyed state:
    the entry with the largest id and the number of rows, per digest."""
    schema = spark.read.parquet(fingerprint_path).schema
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB,
                  spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="4",
                  # else every state partition reserves megabytes of disk in advance
                  spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false"):
        stream = spark.readStream.schema(schema).parquet(fingerprint_path)
        state = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        run = (state.writeStream.outputMode("update").format("noop")
               .option("checkpointLocation", state_path).trigger(availableNow=True).start())
        run.awaitTermination()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """digest, keep_id, locator, group_size: one row per state entry."""
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        state = spark.read.format("statestore").load(state_path)
    keeper, n = (F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key").getField("digest").alias("digest"),
                        keeper["doc_id"].alias("keep_id"), keeper["locator"].alias("locator"),
                        n.alias("group_size"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          digest=sha256_digest) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, locator, row_key.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    row with the largest id stays. Null texts count as empty texts (all of
    them equal). A null id sorts below every other id; a group of null ids
    only keeps all of its rows under a null ``keep_id``. Rows that repeat an
    id and a text are members like any other, and each is kept when its id is
    the group's keeper. An empty table gives no rows. Other columns of the
    input are not looked at.
    """
    spark = docs.sparkSession
    base = shared_folder(spark, "exact_dedup")
    fingerprints(docs, id_col, text_col, digest).write.parquet(f"{base}/fingerprints")
    fold(spark, f"{base}/fingerprints", f"{base}/state")
    read_state(spark, f"{base}/state").write.parquet(f"{base}/entries")
    entries = spark.read.parquet(f"{base}/entries")
    rows = spark.read.parquet(f"{base}/fingerprints").select("doc_id", "digest", "row_key")

    # full bytes of every hit: a digest's smallest and largest text are the same bytes
    hits = entries.where("group_size > 1").select("digest")
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"),
                        row_key(id_col, text_col).alias("row_key"))
    texts = texts.withColumn("digest", digest(F.col("norm"))).join(hits.hint("shuffle_hash"), "digest", "left_semi")
    (texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
     .where("lo != hi").select("digest").write.parquet(f"{base}/collisions"))
    collided = spark.read.schema("digest binary").parquet(f"{base}/collisions")

    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
               "digest", "locator", "row_key"]
    if collided.isEmpty():
        return rows.join(entries, "digest").select(*columns)
    # different texts under one digest: those digests are grouped by the text itself
    sound = rows.join(collided, "digest", "left_anti").join(entries, "digest")
    unsound = texts.join(collided, "digest", "left_semi")
    by_text = unsound.groupBy("digest", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    regrouped = unsound.join(by_text, ["digest", "norm"]).withColumn("locator", F.lit(""))
    return sound.select(*columns).unionByName(regrouped.select(*columns))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, all columns unchanged. Only
    rows that a bitmap of the removed ones lets through are joined with them."""
    gone = written(dedup(docs, id_col, text_col).where("not kept").select(
        F.col("doc_id").alias("__ft_id"), F.col("row_key").alias("__ft_gone")).distinct())
    return without_rows(docs.withColumn("__ft_key", row_key(id_col, text_col)), gone, id_col).select(*docs.columns)


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``keep_first_copies``, but of rows that repeat the keeper's id (or are
    all without an id) only one stays: the largest by all columns, read as JSON (columns of
    any type). Every text is left exactly once."""
    verdict = written(dedup(docs, id_col, text_col).where("group_size > 1").select(
        F.col("doc_id").alias("__ft_id"), F.col("row_key").alias("__ft_gone"), "kept"))
    keyed = docs.withColumn("__ft_key", row_key(id_col, text_col))
    left = without_rows(keyed, written(verdict.where("not kept").drop("kept").distinct()), id_col)
    again = written(verdict.where("kept").groupBy("__ft_id", "__ft_gone").count().where("count > 1"))
    if again.isEmpty():
        return left.select(*docs.columns)
    rest = key_filter(left, "__ft_key", again, "__ft_gone", inside=False).select(*docs.columns)
    maybe = key_filter(left, "__ft_key", again, "__ft_gone").select(
        F.col(id_col).alias("__ft_id"), ascii_lower(F.col(text_col)).alias("__ft_norm"), F.struct(*docs.columns).alias("__ft_row"))
    one = maybe.groupBy("__ft_id", "__ft_norm").agg(F.max_by("__ft_row", F.to_json("__ft_row")).alias("__ft_row"))
    return rest.unionByName(one.select("__ft_row.*"))
