"""User notes on conversations: aliases, tags, notes; merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import clean_tags


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def _filled(df: DataFrame) -> DataFrame:
    """Without rows that say nothing."""
    return df.filter((F.col("alias") != "") | (F.size("tags") > 0) | (F.col("notes") != ""))


def apply_annotations(store: DataFrame, edits: DataFrame) -> DataFrame:
    """store after edits (conversation_id, alias, tags, notes, seq): null keeps a value, blank clears it.

    Of several edits of one conversation each field takes the last non-null one. Rows in which nothing is left
    are removed; edits with a blank id are refused (left out)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"n_{c}")
    new = edits.filter(F.trim("conversation_id") != "").groupBy("conversation_id").agg(last("alias"), last("tags"), last("notes"))
    both = store.join(new, "conversation_id", "full_outer")
    none = F.array().cast("array<string>")
    return _filled(
        both.select(
            "conversation_id",
            F.coalesce(_tidy(F.col("n_alias")), F.col("alias"), F.lit("")).alias("alias"),
            F.coalesce(clean_tags(F.col("n_tags")), F.col("tags"), none).alias("tags"),
            F.coalesce(F.col("n_notes"), F.col("notes"), F.lit("")).alias("notes"),
        )
    )


def merge_annotations(store: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported values win unless they are blank."""
    i = imported.select("conversation_id", F.col("alias").alias("i_alias"), F.col("tags").alias("i_tags"), F.col("notes").alias("i_notes"))
    both = store.join(i, "conversation_id", "full_outer")
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    tags = F.when(F.coalesce(F.size("i_tags"), F.lit(0)) > 0, F.col("i_tags")).otherwise(F.coalesce("tags", F.array().cast("array<string>")))
    return _filled(both.select("conversation_id", pick("i_alias", "alias").alias("alias"), tags.alias("tags"), pick("i_notes", "notes").alias("notes")))


def add_tags(tags: Column, more: Column) -> Column:
    """Union without regard to case; the spelling that was there first stays."""
    return clean_tags(F.concat(tags, more))


def remove_tags(tags: Column, less: Column) -> Column:
    return F.filter(tags, lambda t: ~F.exists(less, lambda s: F.lower(s) == F.lower(t)))


def find_by_tag(store: DataFrame, tag: str) -> DataFrame:
    return store.filter(F.exists("tags", lambda t: F.lower(t) == tag.strip().lower()))


def get(store: DataFrame, conversation_id: str) -> DataFrame:
    """The annotation of one conversation, or one empty record."""
    asked = store.sparkSession.createDataFrame([(conversation_id,)], "conversation_id string")
    found = asked.join(store.filter(F.col("conversation_id") == conversation_id), "conversation_id", "left")
    return found.select("conversation_id", F.coalesce("alias", F.lit("")).alias("alias"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("notes", F.lit("")).alias("notes"))


def with_conversations(store: DataFrame, conversations: DataFrame) -> DataFrame:
    """Annotations of known conversations with title and provider; orphans drop out."""
    return store.join(conversations.select("conversation_id", "title", "provider"), "conversation_id")


def by_thread(store: DataFrame, conversations: DataFrame, thread_id: str) -> DataFrame:
    """Annotations of a thread's conversations; a blank thread id matches nothing."""
    if not thread_id.strip():
        return store.limit(0)
    return store.join(conversations.filter(F.col("thread_id") == thread_id).select("conversation_id"), "conversation_id", "left_semi")


def latest_edits(edits: DataFrame) -> DataFrame:
    """The last edit of each conversation, whole."""
    w = Window.partitionBy("conversation_id").orderBy(F.col("seq").desc())
    return edits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
