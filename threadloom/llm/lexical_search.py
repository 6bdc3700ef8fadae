"""Ranked lexical search: hashed max-sketches give upper bounds, candidates are rescored exactly until the threshold.

A document's sketch keeps, for each of 2^COORD_BITS coordinates to which its terms are hashed, the greatest number of
occurrences of such a term; what a term adds to a score grows with its occurrences, so at fixed corpus figures that is the
greatest impact, and the sketch stays right when the corpus grows. Only coordinates that are not 0 are stored. A query's
terms look up their coordinates in all sketches at once, which bounds its scores. The documents with the greatest bounds
are scored exactly; then those whose bound passes the k-th best score so found. No other can be among the k best."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.byte_words import split_words, text_runs, word_hashes, word_table
from threadloom.llm.text import LETTER_WORD_ANY_CASE, ascii_lower, words
from threadloom.session import join_checked, ship, stash

TOP = 10
TERMS = word_table(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
COORD_BITS = 22
#: Candidates of each query that are scored first.
FIRST = 40
#: Queries in one pass over the sketches, about, and the terms that they have together, about.
BATCH_QUERIES, BATCH_TERMS = 1_000, 200_000
#: Documents times queries that are bounded at once.
AT_ONCE = 1 << 20
#: An occurrence count in a sketch that stands for all from it on; the document's length bounds those.
FULL = 0xFFFF
NO_ID = np.iinfo(np.int64).max

INDEX = "doc_id bigint, text_hash bigint, n bigint, coords binary, most binary, term string, docs bigint"


def coordinates(terms: pa.Array) -> np.ndarray:
    return (word_hashes(terms) >> np.uint64(32 - COORD_BITS)).astype(np.uint32)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, doc_id, text_hash): a row for each document with terms, and for each run of texts the terms' numbers of documents."""
    names = [part.split()[0] for part in INDEX.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
    for batch in text_runs(batches, 0):
        w = split_words(batch.column(0), TERMS)
        if not len(w.ids):
            continue
        width = len(w.distinct)
        key, tf = np.unique(w.row * width + w.ids, return_counts=True)
        row, term = key // width, key % width
        coord = coordinates(w.distinct)[term]
        order = np.lexsort((coord, row))
        row, coord, tf = row[order], coord[order], tf[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) > 0) | (np.diff(coord.astype(np.int64)) > 0)]))
        most = np.minimum(np.maximum.reduceat(tf, new), FULL).astype(np.uint16)
        row_of, coord = row[new], coord[new]
        length = np.bincount(w.row, minlength=len(batch))
        there = np.flatnonzero(length)
        cuts = np.searchsorted(row_of, np.append(there, len(batch)))
        parts = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        chosen = pa.array(there)
        sketches = [batch.column(1).take(chosen), batch.column(2).take(chosen), pa.array(length[there], pa.int64()), parts(coord), parts(most)]
        yield pa.RecordBatch.from_arrays(sketches + [pa.nulls(len(there), t) for t in types[5:]], names=names)
        counts = [w.distinct.cast(pa.binary()).cast(pa.string()), pa.array(np.bincount(term, minlength=width), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.nulls(width, t) for t in types[:5]] + counts, names=names)


def sketch_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder: sketches (doc_id, text_hash, n, coords, most) where term
    is null, and the terms' numbers of documents (term, docs), several rows a term, where it is not. It depends on no query."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return stash(rows.select("text", "doc_id", F.xxhash64("text").alias("text_hash")).mapInArrow(_index, INDEX), "sketches")


@dataclass(frozen=True)
class QueryBatch:
    """Some queries by number: for each coordinate of theirs the queries that have a term there and its weight (starts, query,
    weight), and each query's threshold: the least bound that still matters, and the id below which an equal one does."""

    keys: tuple[int, ...]
    column: np.ndarray  # of a coordinate's number, or -1
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    least: np.ndarray
    before: np.ndarray


def query_batch(rows: list[tuple[int, str, int]], thresholds: dict[int, tuple[int, int]]) -> QueryBatch:
    """From (query key, term, weight)."""
    keys = tuple(sorted({k for k, _, _ in rows}))
    number = {k: i for i, k in enumerate(keys)}
    coord = coordinates(pa.array([t.encode() for _, t, _ in rows], pa.binary()))
    query, weight = np.array([number[k] for k, _, _ in rows]), np.array([w for _, _, w in rows], np.float64)
    used, at = np.unique(coord, return_inverse=True)
    order = np.argsort(at, kind="stable")
    column = np.full(1 << COORD_BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    limit = [thresholds.get(k, (0, 0)) for k in keys]
    return QueryBatch(keys, column, np.searchsorted(at[order], np.arange(len(used) + 1)), query[order], weight[order], np.array([x for x, _ in limit], np.float64), np.array([x for _, x in limit], np.int64))


def bounds(q: QueryBatch, lengths: np.ndarray, sizes: np.ndarray, coords: np.ndarray, most: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(documents, queries): the most that each query can score. Sums of whole numbers in doubles."""
    m = (10 + (90 * n_docs * lengths) // n_terms).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    col = q.column[coords]
    use = col >= 0
    doc, col, tf = doc[use], col[use], most[use].astype(np.int64)
    tf = np.where(tf == FULL, lengths[doc], tf)
    gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    reach = q.starts[col + 1] - q.starts[col]
    entry = np.repeat(q.starts[col] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
    wide = len(q.keys)
    total = np.bincount(np.repeat(doc, reach) * wide + q.query[entry], np.repeat(gain, reach) * q.weight[entry], minlength=len(sizes) * wide)
    return total.reshape(len(sizes), wide)


def _candidates(shared, n_docs: int, n_terms: int, first: int | None):
    """(key, doc_id, text_hash, bound): of a task's documents the first for each query, or all that pass its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: QueryBatch = shared.value
        keys = np.array(q.keys, np.int64)
        least, before = q.least.copy(), q.before.copy()
        held = [np.empty(0, np.int64) for _ in range(3)] + [np.empty(0)]

        def out(query, ids, hashes, bound) -> pa.RecordBatch:
            columns = [pa.array(keys[query]), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(hashes), pa.array(bound.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "text_hash", "bound"])

        for batch in batches:
            step = max(1, AT_ONCE // len(keys))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                hashes = part.column(1).to_numpy(zero_copy_only=False)
                coords = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column(3)]
                most = [np.frombuffer(x.as_buffer(), np.uint16) for x in part.column(4)]
                sizes = np.array([len(x) for x in coords])
                bound = bounds(q, part.column(2).to_numpy(), sizes, np.concatenate(coords), np.concatenate(most), n_docs, n_terms)
                doc, query = np.nonzero((bound > 0) & ((bound > least) | ((bound == least) & (ids[:, None] < before))))
                found = [query, ids[doc], hashes[doc], bound[doc, query]]
                if first is None:
                    if len(doc):
                        yield out(*found)
                    continue
                held = [np.concatenate(x) for x in zip(held, found, strict=True)]
                order = np.lexsort((held[1], -held[3], held[0]))
                held = [x[order] for x in held]
                place = np.arange(len(order)) - np.searchsorted(held[0], held[0])
                held = [x[place < first] for x in held]
                last = place[place < first] == first - 1
                least[held[0][last]], before[held[0][last]] = held[3][last], held[1][last]
        if first is not None and len(held[0]):
            yield out(*held)

    return run


def impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """What tf occurrences in a document of n terms give, before the term's weight: whole numbers, rounded down."""
    m = F.lit(10) + F.call_function("div", F.lit(90).cast("long") * n * F.lit(n_docs), F.lit(n_terms))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000) * tf + F.lit(8) * m)


def rescore(pairs: DataFrame, docs: DataFrame, terms: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(key, doc_id, score) for pairs (key, doc_id, text_hash), a row for each row of docs: exact, from the whole texts.

    The texts that any pair names are read once each, and of their terms only those of the queries are counted."""
    x = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "text_hash")
    wanted = stash(pairs.withColumn("x", x).select("key", "x"), "rescored")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = join_checked(rows.withColumn("x", x), wanted.select("x").distinct(), "x", "left_semi")
    once = texts.groupBy("x").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    tokens = once.select("x", "copies", words(ascii_lower(F.col("text")), LETTER_WORD_ANY_CASE).alias("t"))
    tokens = tokens.select("x", "copies", F.size("t").cast("long").alias("n"), F.explode("t").alias("term"))
    counted = join_checked(tokens, terms.select("term").distinct(), "term", "left_semi").groupBy("x", "copies", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    of_key = wanted.join(counted, "x").join(terms.select("key", "term", "weight"), ["key", "term"])
    part = F.col("weight") * impact(F.col("tf"), F.col("n"), n_docs, n_terms)
    scored = of_key.groupBy("key", "x", "copies").agg(F.sum(part).alias("score")).filter("score > 0")
    each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("key", F.when(~F.col("x.none"), F.col("x.id")).alias("doc_id"), "score")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query: item_id, rank, doc_id, score.

    Reads doc_id (an integer) and text of docs, item_id and text of queries; other columns don't matter. Documents and
    queries of null or empty text have no terms, and no place in N, L or the result. Equal scores stand by doc_id, a null
    one last; repeated rows of docs have a place each, repeated queries are asked once, and queries that share an id but not
    the text are ranked each for itself. Very long texts are read whole. Empty tables give no rows. index: what
    sketch_index(docs) has given, to be used again."""
    spark = docs.sparkSession
    index = sketch_index(docs) if index is None else index
    ship(spark)
    sketches, frequencies = index.filter("term is null").select("doc_id", "text_hash", "n", "coords", "most"), index.filter("term is not null").select("term", "docs")
    figures = sketches.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = figures["docs"], figures["terms"]
    items = queries.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("key"), "item_id", F.array_distinct(words(ascii_lower(F.col("text")), LETTER_WORD_ANY_CASE)).alias("terms")).filter(F.size("terms") > 0)
    items = stash(items, "queries")
    pairs = items.select("key", F.explode("terms").alias("term"))
    df = join_checked(frequencies, pairs.select("term").distinct(), "term").groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    terms = stash(pairs.join(df.select("term", weight.alias("weight")), "term"), "query-terms")
    size = terms.agg(F.countDistinct("key").alias("queries"), F.count(F.lit(1)).alias("terms")).first()
    batches = max(1, -(-size["queries"] // BATCH_QUERIES), -(-size["terms"] // BATCH_TERMS))
    found = []
    for number in range(batches):
        own = terms.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == number)
        rows = [(r["key"], r["term"], r["weight"]) for r in own.collect()]  # BATCH_TERMS of them, about
        if not rows:
            continue
        schema = "key bigint, doc_id bigint, text_hash bigint, bound bigint"
        ask = lambda limits, first, rows=rows: sketches.mapInArrow(_candidates(spark.sparkContext.broadcast(query_batch(rows, limits)), n_docs, n_terms, first), schema)
        order = Window.partitionBy("key").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
        head = stash(ask({}, FIRST).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(FIRST, k)).drop("place"), "first-candidates")
        scored = stash(rescore(head, docs, own, n_docs, n_terms), "first-scores")
        last = _ranked(scored, k).filter(F.col("rank") == k).select("key", "score", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id")).collect()  # one a query
        rest = ask({r["key"]: (r["score"], r["id"]) for r in last}, None).select("key", "doc_id", "text_hash")
        same = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
        rest = join_checked(rest.withColumn("x", same), head.select("key", same.alias("x")), ["key", "x"], "left_anti").drop("x").distinct()
        found.append(scored.unionByName(rescore(rest, docs, own, n_docs, n_terms)))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return _ranked(whole, k).join(items.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
