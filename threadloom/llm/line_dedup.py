"""Cross-site boilerplate lines by HyperLogLog spread, with exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import let
from threadloom.session import join_checked, stash

MIN_SITES = 10
LOG_K = 11
#: Six standard errors of a sketch with 2^LOG_K registers: beyond this band around MIN_SITES the estimate decides.
BAND = 6 * 1.04 / 2 ** (LOG_K / 2)
LINE_ROWS = 500_000


def line_key(line: Column, min_chars: int = 1) -> Column:
    """Hash of a line without outer blanks; null for one under min_chars (1: for blank ones only)."""
    return let(F.trim(line), lambda s: F.when(F.length(s) >= max(1, min_chars), F.xxhash64(s)))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = 1) -> DataFrame:
    """(h): keys of the lines that stand on min_sites distinct sites or more. docs: text, site.

    A line of a single site, the usual case, is told by its least and greatest site and needs no sketch."""
    lines = docs.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: line_key(x, min_chars)))).alias("h")).filter("h is not null and site is not null")
    s = F.xxhash64("site")
    several = lines.groupBy("h").agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.count(F.lit(1)).alias("n")).filter((F.col("lo") != F.col("hi")) & (F.col("n") >= min_sites)).select("h")
    several = stash(several, "lines")
    spread = join_checked(lines, several, "h", rows=LINE_ROWS).groupBy("h").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = stash(spread, "spread")
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    sure = spread.filter(F.col("sites") > high).select("h")
    near = stash(spread.filter(F.col("sites").between(low, high)).select("h"), "near")
    exact = join_checked(lines, near, "h", rows=LINE_ROWS).select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("h")
    return stash(sure.unionByName(exact), "boilerplate")


def strip_boilerplate(docs: DataFrame, site: Column | None = None, min_sites: int = MIN_SITES, min_chars: int = 1) -> DataFrame:
    """(doc_id, text_hash, removed): the positions of boilerplate lines, for the rows of docs that have any.

    site: source by default; a null site counts for no spread, but its lines are removed alike."""
    own = docs.select("doc_id", "text", (F.col("source") if site is None else site).alias("site")).filter(F.col("text").isNotNull())
    found = boilerplate_lines(own.select("text", "site"), min_sites, min_chars)
    keyed = own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.transform(F.split("text", "\n"), lambda x: line_key(x, min_chars))).alias("pos", "h")).filter("h is not null")
    hits = join_checked(keyed, found, "h", "left_semi", LINE_ROWS)
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("removed"))


def dedup_lines(docs: DataFrame, site: Column | None = None, min_sites: int = MIN_SITES, min_chars: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, clean_text.

    Reads doc_id, text and source; other columns don't matter. Lines are split at \\n and compared without outer
    blanks; blank lines, and lines under min_chars characters where that is asked for, are never removed. A null
    text stays null and has no line; an empty one has one. Very long texts and lines are read whole, by their hashes. Rows that share an id are cleaned by their own texts; repeated rows each. Empty input
    gives no rows."""
    removed = strip_boilerplate(docs, site, min_sites, min_chars).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "removed")
    left = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    joined = left.join(removed, left.doc_id.eqNullSafe(removed.k_id) & (left.h == removed.k_hash), "left")
    kept = let(F.array_sort("removed"), lambda r: F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(r, i)))
    clean = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        clean.alias("clean_text"),
    )
