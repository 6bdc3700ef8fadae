"""join_split against the plain join: hot keys over several tasks, nulls, clashing names."""

import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.session import hot_keys, join_split


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(session, "HOT_ROWS", 5)
    left = spark.range(200).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 17).alias("k"), "id", F.lit("x").alias("block__"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (4, "c"), (99, "d"), (None, "e")], "k long, v string")
    want, got = left.join(right, ["k"], how), join_split(left, right, ["k"], ["id"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_rows_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 100)
    left = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert [tuple(r) for r in hot_keys(left, ["k"]).collect()] == [(1, 10)]
    right = spark.createDataFrame([(1, 7)], "k int, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = join_split(left, right, ["k"], ["id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 1000


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        join_split(spark.range(1), spark.range(1), ["id"], ["id"], "full")
