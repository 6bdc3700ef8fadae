"""Ranked search that skips: postings in blocks of documents, each with the greatest share that a term has of a score there.

A block holds documents of like length, so that its greatest share is near what its documents reach. A page is found in two
looks: block by block, from ids and greatest shares alone, how many documents match and what the best of them can reach; then
frequencies and lengths of only those blocks that can still reach the page. The total comes from the first look, so it is exact."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalars import iso_to_ms
from threadloom.operators.filters import date_filter, provider_filter
from threadloom.operators.privacy import strip_hidden_chars
from threadloom.operators.search import IDF_FLOOR, K1, B, Clause, open_index, parse_query, search
from threadloom.session import stash

#: Documents of a block, about.
BLOCK_DOCS = 128
#: Classes of length, at most; beyond so many times BLOCK_DOCS documents a class is cut by a hash of the id.
LENGTHS = 512
#: Scores are ordered by 9 decimals; bounds give way by more than that.
SLACK = 1e-8


def share(tf: Column, length: Column, average: Column) -> Column:
    """What a term adds to a score, but for its weight: it grows with tf and falls with length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def store_blocks(spark: SparkSession, path: str, block_docs: int = BLOCK_DOCS, partitions: int = 32) -> None:
    """Beside the index that store_index() wrote: blocks (term, block, most, ids, tfs, lens), sorted by term, and the corpus' size.

    The lists of a row are as long as a block has documents with the term: a frequent term is many rows."""
    stats, postings = spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/postings")
    stats.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len")).write.mode("overwrite").parquet(f"{path}/size")
    size = spark.read.parquet(f"{path}/size").first()
    classes = max(1, min(LENGTHS, size.n_docs // block_docs))
    edges = (stats.agg(F.percentile_approx("len", [i / classes for i in range(1, classes)], 10_000).alias("e")).first().e or []) if classes > 1 else []
    parts = max(1, size.n_docs // (block_docs * classes))
    rank = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("len"))) if edges else F.lit(0)
    placed = stats.withColumn("block", rank.cast("long") * parts + F.pmod(F.xxhash64("conversation_id"), F.lit(parts)))
    found = postings.groupBy("term", "conversation_id").agg(F.count(F.lit(1)).alias("tf")).join(placed, "conversation_id")
    lists = found.groupBy("term", "block").agg(
        F.max(share(F.col("tf"), F.col("len"), F.lit(size.avg_len))).alias("most"),
        F.array_sort(F.collect_list(F.struct("conversation_id", "tf", "len"))).alias("docs"),
    )
    out = lists.select("term", "block", "most", F.col("docs.conversation_id").alias("ids"), F.col("docs.tf").alias("tfs"), F.col("docs.len").alias("lens"))
    out.repartitionByRange(partitions, "term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")


def _of_clauses(lists: DataFrame, clauses: list[Clause], columns: list[str]) -> DataFrame:
    """Rows of the terms that the clauses ask for, once for each clause that does, with its number."""
    tests = [F.col("term").startswith(c.tokens[0]) if c.prefix else F.col("term") == c.tokens[0] for c in clauses]
    marks = F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]), lambda x: x.isNotNull())
    return lists.filter(reduce(lambda x, y: x | y, tests)).select("block", *columns, F.explode(marks).alias("clause"))


def _each(n: int, name: str, agg: Callable[[Column], Column], of: str) -> list[Column]:
    return [agg(F.when(F.col("clause") == i, F.col(of))).alias(f"{name}{i}") for i in range(n)]


def _all(n: int, name: str) -> list[Column]:
    return [F.col(f"{name}{i}") for i in range(n)]


def page_blocks(lists: DataFrame, size: tuple[int, float], clauses: list[Clause], k: int, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(scores, blocks, total): exact scores of all documents that can be among the k best, what each block came to, how many match.

    scores: (conversation_id, bm25). blocks: (block, n, bound, scored). wanted (conversation_id): only these documents count.
    The driver sees sums over all blocks and at most k rows, the best bounds and scores."""
    n, (n_docs, avg_len) = len(clauses), size
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    met = _of_clauses(lists, clauses, ["most", "ids"]).groupBy("block").agg(*_each(n, "ids", merged, "ids"), *_each(n, "most", F.sum, "most"))
    met = met.select("block", *[F.size(c).alias(f"df{i}") for i, c in enumerate(_all(n, "ids"))], *_all(n, "most"), reduce(F.array_intersect, _all(n, "ids")).alias("both"))
    if wanted is not None:
        left = met.select("block", F.explode("both").alias("conversation_id")).join(wanted, "conversation_id", "left_semi").groupBy("block").agg(F.count(F.lit(1)).alias("left"))
        met = met.join(left, "block", "left").withColumn("n", F.coalesce("left", F.lit(0))).drop("left", "both")
    else:
        met = met.withColumn("n", F.size("both")).drop("both")
    met = stash(met, "met")
    sums = met.agg(*[F.coalesce(F.sum(f"df{i}"), F.lit(0)).alias(f"df{i}") for i in range(n)], F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    idf = [max(IDF_FLOOR, math.log((n_docs - sums[f"df{i}"] + 0.5) / (sums[f"df{i}"] + 0.5))) for i in range(n)]
    bound = reduce(lambda x, y: x + y, [F.lit(w) * m for w, m in zip(idf, _all(n, "most"))])
    blocks = met.filter("n > 0").select("block", "n", bound.alias("bound"))

    def scored(some: DataFrame) -> DataFrame:
        rows = _of_clauses(lists, clauses, ["ids", "tfs", "lens"]).join(some.select("block"), "block", "left_semi")
        each = rows.select("clause", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("d")).select("clause", F.col("d.ids").alias("conversation_id"), F.col("d.tfs").alias("tf"), F.col("d.lens").alias("len"))
        docs = each.groupBy("conversation_id").agg(*_each(n, "tf", F.sum, "tf"), F.first("len").alias("len"))
        docs = docs.filter(reduce(lambda x, y: x & y, [c.isNotNull() for c in _all(n, "tf")]))
        docs = docs if wanted is None else docs.join(wanted, "conversation_id", "left_semi")
        parts = [F.lit(w) * share(tf, F.col("len"), F.lit(avg_len)) for w, tf in zip(idf, _all(n, "tf"))]
        return docs.select("conversation_id", (-reduce(lambda x, y: x + y, parts)).alias("bm25"))

    floor = -1.0  # below all bounds: with no more matches than a page has places, all blocks are scored
    if 0 < k < sums.n:
        best, seen, least = blocks.orderBy(F.desc("bound")).limit(k).collect(), 0, 0.0
        for b in best:
            seen, least = seen + b.n, b.bound
            if seen >= k:
                break
        first = scored(blocks.filter(F.col("bound") >= least))  # k matches or more
        floor = -first.select("bm25").orderBy("bm25").limit(k).agg(F.max("bm25")).first()[0] - SLACK
    blocks = blocks.withColumn("scored", F.col("bound") >= floor)
    return scored(blocks.filter("scored")), blocks, sums.n


def search_blocks(spark: SparkSession, path: str, text: str, since: str = "", until: str = "", provider: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """The page that search() gives, column by column, from the index and the blocks in a folder.

    Words and word* are looked up in blocks; with a phrase in the text search() does the work. No token: no hits."""
    clauses = parse_query(text)
    if not clauses or any(len(c.tokens) > 1 for c in clauses):
        return search(*open_index(spark, path), text, since, until, provider, limit, offset)
    heads, size = spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/size").first()
    heads = provider_filter(date_filter(heads, since, until), provider)
    wanted = heads.select("conversation_id") if since or until or provider else None
    scores, _, total = page_blocks(spark.read.parquet(f"{path}/blocks"), (size.n_docs, size.avg_len), clauses, offset + limit, wanted)
    order = [F.round("bm25", 9), F.col("conversation_id")]
    best = scores.orderBy(*order).limit(offset + limit)  # what follows concerns a page, and those before it, only
    page = best.agg(F.collect_list(F.struct(F.round("bm25", 9).alias("by"), "conversation_id", "bm25")).alias("l")).select(F.posexplode(F.array_sort("l")).alias("at", "d")).filter(F.col("at") >= offset)
    page = page.select(F.col("d.conversation_id").alias("conversation_id"), F.col("d.bm25").alias("bm25"), (1.0 / (F.col("at") + 1)).alias("score"))
    thread = F.nullif("thread_id", F.lit("")) if "thread_id" in heads.columns else F.lit(None).cast("string")
    shown = [strip_hidden_chars(F.col("title")).alias("snippet"), "score", "provider", thread.alias("thread_id"), iso_to_ms(F.col("created_at")).alias("ts_ms")]
    return heads.join(F.broadcast(page), "conversation_id").select("conversation_id", *shown, "bm25", F.lit(total).cast("long").alias("total")).orderBy(F.desc("score"))
