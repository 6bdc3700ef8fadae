"""The conversation index: bodies, counts, models, upserts, archived bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_conversation_index(conversations: DataFrame, blocks: DataFrame) -> DataFrame:
    """conversations with turn_count, body and char_count.

    body is the title, a line break and the non-empty block texts in order; char_count is its length."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("turn_idx", "block_idx", "text"))))
    texts = blocks.groupBy("conversation_id").agg(F.countDistinct("turn_idx").alias("turn_count"), ordered.alias("t"))
    joined = conversations.join(texts, "conversation_id", "left")
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce(F.array_join(F.transform("t", lambda x: x.text), "\n"), F.lit("")))
    return joined.withColumn("turn_count", F.coalesce("turn_count", F.lit(0)).cast("long")).withColumn("body", body).withColumn("char_count", F.length("body").cast("long")).drop("t")


def conversation_models(incoming: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(conversation_id, model_id): trimmed, blanks count as absent, and an absent one never erases a known one."""
    new = incoming.select("conversation_id", F.nullif(F.trim("model_id"), F.lit("")).alias("new"))
    if existing is None:
        return new.filter("new is not null").select("conversation_id", F.col("new").alias("model_id"))
    both = existing.select("conversation_id", F.col("model_id").alias("old")).join(new, "conversation_id", "full_outer")
    return both.select("conversation_id", F.coalesce("new", "old").alias("model_id")).filter("model_id is not null")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """existing with the rows of incoming in place of those of equal key; replaying incoming changes nothing.

    order: of incoming rows of one key the greatest stays; needed only if keys can repeat."""
    if order is not None:
        rest = [c for c in incoming.columns if c not in keys]
        incoming = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*incoming.columns)
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def upsert_terms(existing: DataFrame, incoming: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of the changed conversations replaced as a whole."""
    return existing.join(changed.select("conversation_id").distinct(), "conversation_id", "left_anti").unionByName(incoming)


def write_bodies(blocks: DataFrame, path: str, buckets: int = 16) -> DataFrame:
    """Write turns and blocks under path, zstd, by hash of the conversation; returns (conversation_id, text_bytes)."""
    part = F.pmod(F.xxhash64("conversation_id"), F.lit(buckets)).cast("int")
    blocks.withColumn("part", part).repartition("part").sortWithinPartitions("part", "conversation_id", "turn_idx", "block_idx").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)
    return body_sizes(blocks)


def body_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("conversation_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("text_bytes"))


def load_body(conversations: DataFrame, bodies: DataFrame, conversation_id: str) -> DataFrame:
    """Blocks of one conversation with has_body: a stored conversation without blocks is one row with nulls and
    has_body true, one that was never stored has_body false; an unknown id gives no row."""
    one = conversations.filter(F.col("conversation_id") == conversation_id).select("conversation_id", F.col("has_body"))
    return one.join(bodies.filter(F.col("conversation_id") == conversation_id), "conversation_id", "left")
