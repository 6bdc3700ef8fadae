"""Counts and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(index: DataFrame, threads: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: conversations, turns, characters, threads, edges, and the count per provider as key=n texts."""
    by = index.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.sum("turn_count").alias("t"), F.sum("char_count").alias("c"))
    top = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("conversations"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("turns"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("chars"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "provider", "n"))), ",").alias("by_provider"),
    )
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return top.crossJoin(n(threads, "threads")).crossJoin(n(edges, "edges"))


def aggregate_stats(view: DataFrame) -> DataFrame:
    """(facet, key, n, turns, chars): provider and account histograms and the totals, from the allow-list only."""
    sets = view.groupingSets([["provider"], ["account"], []], "provider", "account").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("turn_count"), F.lit(0)).alias("turns"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars")
    )
    facet = F.when(F.col("g") == 1, "provider").when(F.col("g") == 2, "account").otherwise("all")
    return sets.select(facet.alias("facet"), F.when(F.col("g") == 1, F.col("provider")).when(F.col("g") == 2, F.col("account")).otherwise("").alias("key"), "n", "turns", "chars")


def tag_counts(annotations: DataFrame) -> DataFrame:
    """(tag, n) regardless of case; the least spelling names it; a conversation counts once."""
    each = annotations.select("conversation_id", F.explode("tags").alias("tag"))
    return each.groupBy(F.lower("tag").alias("k")).agg(F.min("tag").alias("tag"), F.countDistinct("conversation_id").alias("n")).select("tag", "n")


def event_census(events: DataFrame, doc: str, kind: str) -> DataFrame:
    """(doc, census): counts by kind as a map."""
    counts = events.groupBy(doc, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("n"))))).alias("census"))


def ingest_report(conversations: DataFrame, duplicates: DataFrame, errors: DataFrame) -> DataFrame:
    """(file, conversations, duplicates, errors), each input with a column file."""
    n = lambda df, name: df.groupBy("file").agg(F.count(F.lit(1)).alias(name))
    joined = n(conversations, "conversations").join(n(duplicates, "duplicates"), "file", "full_outer").join(n(errors, "errors"), "file", "full_outer")
    return joined.na.fill(0)


def corpus_size(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("records"))
