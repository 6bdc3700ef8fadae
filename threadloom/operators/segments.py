"""A stored search index that changes by segments: what changed is written beside what stays, and merged when there are many.

A segment has its conversations' heads, postings and lengths, and the ids that it replaces or takes away from earlier segments.
Readers leave out what a later segment names, so that document frequencies, lengths and hits are those of the live conversations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import search
from threadloom.session import join_checked
from threadloom.sources.versions import announce, newest, remove

#: Segments beyond which all are merged into one.
MOST_SEGMENTS = 8


def _segments(spark: SparkSession, path: str) -> list[str]:
    return (newest(spark, path) or "").split()


def live(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of one part (heads, postings or stats) of the live conversations, over all segments."""
    names = _segments(spark, path)
    rows = lambda what: reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{n}/{what}").withColumn("segment__", F.lit(i)) for i, n in enumerate(names)])
    found = rows(part)
    if len(names) == 1:
        return found.drop("segment__")
    gone = rows("gone").groupBy(F.col("conversation_id").alias("gone__")).agg(F.max("segment__").alias("by__"))
    replaced = (F.col("conversation_id") == F.col("gone__")) & (F.col("segment__") < F.col("by__"))
    return join_checked(found, gone, replaced, "left_anti").drop("segment__")


def open_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, postings, stats), as search() takes them."""
    return live(spark, path, "heads"), live(spark, path, "postings"), live(spark, path, "stats")


def _write(index: DataFrame, gone: DataFrame, path: str, partitions: int) -> str:
    name = f"segment-{uuid.uuid4().hex}"
    search.store_index(index, f"{path}/{name}", partitions)
    gone.select("conversation_id").distinct().write.parquet(f"{path}/{name}/gone")
    return name


def create_index(index: DataFrame, path: str, partitions: int = 32) -> None:
    """A stored index of one segment; index as build_conversation_index() gives it."""
    announce(index.sparkSession, path, _write(index, index.limit(0), path, partitions))


def upsert_index(changed: DataFrame, path: str, deleted: DataFrame | None = None, partitions: int = 8) -> None:
    """Put changed conversations in place of those of equal id, and take deleted ones (conversation_id) away; what is in both goes.

    Only the changed ones are tokenized and written; readers see all of it at once. Beyond MOST_SEGMENTS all are merged."""
    spark = changed.sparkSession
    gone = changed.select("conversation_id")
    if deleted is not None:
        gone = gone.unionByName(deleted.select("conversation_id"))
        changed = changed.join(deleted.select("conversation_id").distinct(), "conversation_id", "left_anti").select(*changed.columns)
    names = [*_segments(spark, path), _write(changed, gone, path, partitions)]
    announce(spark, path, " ".join(names))
    if len(names) > MOST_SEGMENTS:
        merge_segments(spark, path)


def merge_segments(spark: SparkSession, path: str, partitions: int = 32) -> None:
    """One segment of all live rows in place of many; the old ones go once the new one is announced."""
    old = _segments(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    heads, postings, stats = open_segments(spark, path)
    heads.write.parquet(f"{path}/{name}/heads")
    rows = stats.agg(F.sum("len")).first()[0] or 0
    search.write_postings(postings, f"{path}/{name}/postings", partitions, rows)
    stats.write.parquet(f"{path}/{name}/stats")
    heads.select("conversation_id").limit(0).write.parquet(f"{path}/{name}/gone")
    announce(spark, path, name)
    for n in old:
        remove(spark, f"{path}/{n}")
