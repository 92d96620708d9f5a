"""The training-data pipeline over ``documents``.

Toxic documents go; then exact copies (of equal texts the largest doc_id stays),
near copies (of every group the smallest doc_id stays) and passages that repeat
anywhere; what is left is packed into sequences. Every stage works on all that
the one before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flagtide.llm import exact_dedup, minhash, packing, suffix_dedup, toxicity
from flagtide.llm.common import table
from flagtide.session import delete, scratch, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the lexicon is learned from ``labels``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact copies (after lower-casing A-Z) go; the largest doc_id stays, and one
    row only where rows repeat that id or have none."""
    return exact_dedup.keep_one_copy(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: five-word shingles, a
    similarity of 0.8 or more."""
    return minhash.keep_representatives(docs, minhash.Settings(words=5, least=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur more than once are cut out of the
    texts, to whole characters; ``n_chars`` follows. No row goes, a text that
    consists of such passages becomes empty; other texts stay as they are."""
    cut = suffix_dedup.remove_repeats(docs, prefix="__ft_").withColumn("__ft_changed", F.col("__ft_n_removed") > 0)
    text = F.when(F.col("__ft_changed"), F.col("__ft_kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("__ft_changed"), F.length("__ft_kept_text")).otherwise(F.col("n_chars")).cast(
        docs.schema["n_chars"].dataType)
    return cut.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens by best-fit decreasing, one row per piece."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash_near_dedup", drop_near_copies),
          ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack)]

# the lexicon automata, signatures and packing have no SQL form; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again. What a
    stage has written on its way goes when its result is there, and that goes when
    the next one is: two copies of the documents at most are kept, then the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch(spark) as made:
            path = store(stage(spark, docs, sf_dir))
            made.keep(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
