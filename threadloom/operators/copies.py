"""Physical copies of sessions consolidated into logical sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import is_uuid, uuid_in


def session_key() -> Column:
    """Copies belong together by byte-equal id; a blank id identifies nothing, so such a copy stands alone."""
    blank = F.trim("session_id") == ""
    return F.when(blank, F.concat(F.lit("path:"), "file_path")).otherwise(F.concat(F.lit("id:"), "session_id"))


def canonical_order() -> list[Column]:
    """Live first, then larger, newer (undated last), then by path without case, then by path."""
    return [(F.col("store_kind") != "live").cast("int"), F.col("size_bytes").desc(), F.col("last_write_ms").desc_nulls_last(), F.lower("file_path"), F.col("file_path")]


def consolidate(copies: DataFrame) -> DataFrame:
    """copies with session_key and rank in the session; rank 1 is the canonical copy. Every copy stays."""
    keyed = copies.withColumn("session_key", session_key())
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy("session_key").orderBy(*canonical_order())))


def session_view(copies: DataFrame) -> DataFrame:
    """One row per session: canonical copy, copy_count, duplicate_paths, is_identified, has_larger_copy."""
    c = consolidate(copies)
    grouped = c.groupBy("session_key").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("session_id", "file_path", "size_bytes", "store_kind"))).alias("top"),
        F.count(F.lit(1)).alias("copy_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "file_path")))), lambda x: x.file_path).alias("duplicate_paths"),
        F.max("size_bytes").alias("largest"),
    )
    return grouped.select(
        F.col("top.session_id").alias("session_id"), F.col("top.file_path").alias("canonical_path"), F.col("top.store_kind").alias("store_kind"), F.col("top.size_bytes").alias("size_bytes"),
        "copy_count", "duplicate_paths", (F.trim("top.session_id") != "").alias("is_identified"), (F.col("largest") > F.col("top.size_bytes")).alias("has_larger_copy"),
    )


def ordered_sessions(copies: DataFrame) -> DataFrame:
    return session_view(copies).orderBy("session_id", F.lower("canonical_path"), "canonical_path")


def dedup_summary(copies: DataFrame) -> DataFrame:
    """One row: sessions, copies, duplicates, flagged (a copy larger than the canonical one), unidentified."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return session_view(copies).agg(
        F.count(F.lit(1)).alias("sessions"), n(F.col("copy_count")).alias("copies"), n(F.col("copy_count") - 1).alias("duplicates"), n(F.col("has_larger_copy")).alias("flagged"), n(~F.col("is_identified")).alias("unidentified")
    )


def duplicate_report(copies: DataFrame, shown: int = 8) -> DataFrame:
    """(bucket, position, session_id, canonical_path, copy_count, has_larger_copy, hidden).

    Buckets: duplicates (two copies or more), unidentified, single (a row with the count alone). In a bucket:
    truncated first, more copies, larger, then by path and id; the first so many, and how many are hidden."""
    v = session_view(copies).withColumn("bucket", F.when(~F.col("is_identified"), "unidentified").when(F.col("copy_count") > 1, "duplicates").otherwise("single"))
    listed = v.filter(F.col("bucket") != "single")
    order = Window.partitionBy("bucket").orderBy(F.col("has_larger_copy").desc(), F.col("copy_count").desc(), F.col("size_bytes").desc(), "canonical_path", "session_id")
    top = listed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= shown)
    size = v.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    rows = top.join(F.broadcast(size), "bucket").select("bucket", "position", "session_id", "canonical_path", "copy_count", "has_larger_copy", F.greatest(F.lit(0).cast("long"), F.col("n") - shown).alias("hidden"))
    single = size.filter(F.col("bucket") == "single").select("bucket", F.lit(0).alias("position"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("canonical_path"), F.lit(None).cast("long").alias("copy_count"), F.lit(None).cast("boolean").alias("has_larger_copy"), F.col("n").alias("hidden"))
    return rows.unionByName(single)


def scan_copies(listing: DataFrame, store_kind: str) -> DataFrame:
    """Copies from a file listing (path, length, modificationTime); only a UUID-shaped name gives an id."""
    found = uuid_in(F.col("path"))
    return listing.select(
        F.when(is_uuid(found), found).otherwise("").alias("session_id"), F.col("path").alias("file_path"), F.lit(store_kind).alias("store_kind"),
        F.unix_millis("modificationTime").alias("last_write_ms"), F.col("length").cast("long").alias("size_bytes"),
    )


def accumulate_copies(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """known with scanned in place of rows of equal path; a copy that this scan did not see stays."""
    return known.join(scanned.select("file_path"), "file_path", "left_anti").unionByName(scanned)
