"""Helpers: the key bitmap never loses a row, settings come back."""

from pyspark.sql import functions as F

from flagtide.llm import common as C


def test_key_filter_splits_rows_and_keeps_every_match(spark):
    df = spark.range(20_000).withColumn("text", F.concat(F.lit("t"), "id")).withColumn("__ft_other", F.lit(1))
    keys = spark.range(0, 20_000, 7).withColumnRenamed("id", "key").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS key"))
    inside = C.key_filter(df, "id", keys, "key")
    outside = C.key_filter(df, "id", keys, "key", inside=False)
    assert inside.columns == df.columns
    got, rest = {r.id for r in inside.collect()}, {r.id for r in outside.collect()}
    assert got | rest == set(range(20_000)) and not got & rest
    assert set(range(0, 20_000, 7)) <= got and len(got) < 1.3 * 20_000 / 7
    assert C.key_filter(df, "id", keys.limit(0), "key").count() == 0


def test_null_keys_are_kept_outside(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "id long, text string")
    keys = spark.createDataFrame([(1,)], "key long")
    assert [r.text for r in C.key_filter(df, "id", keys, "key").collect() if r.text == "b"] == ["b"]
    both = C.key_filter(df, "id", keys, "key").count() + C.key_filter(df, "id", keys, "key", inside=False).count()
    assert both == 2


def test_settings_come_back(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB"
    before = spark.conf.get(name, None)
    with C.settings(spark, spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="9"):
        assert spark.conf.get(name) == "9"
    assert spark.conf.get(name, None) == before


def test_ascii_lower(spark):
    df = spark.createDataFrame([("ABC z",), ("ÀÉ X",), (None,), ("İ",)], "t string")
    assert [r[0] for r in df.select(C.ascii_lower(F.col("t"))).collect()] == ["abc z", "ÀÉ x", "", "İ"]
