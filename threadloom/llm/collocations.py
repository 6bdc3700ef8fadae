"""Phrase collocations from a weighted de Bruijn graph of word grams.

An edge is the longest gram that begins at a word, its node the gram without its last word. Edges are counted once; how
often a shorter phrase occurs is the flow through it: what leaves it along longer grams, and the grams that end with it.
Paths without branches are compacted into passages of any length.

A gram ends after LONGEST words, where its piece ends, or where no longer phrase can be frequent, which changes the count
of no frequent phrase. To know that, grams are first counted by hash buckets, in tables of fixed size: words and
pairs, then grams of three words and more whose pairs are frequent. A collision only makes an edge longer than it need be."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.byte_words import Words, split_words, text_runs, word_hashes, word_table
from threadloom.session import discard, join_checked, ship, stash

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"
WORDS = word_table(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Hash buckets of grams, in each of two tables; a bucket is a byte while counting and a bit in what is sent to the tasks: 2 MB.
#: SLICES is also the number of shards of the edges.
BUCKET_BITS = 24
SLICES = 128
#: Counts are held to this, which must be at least the least count that matters.
FULL = 255
#: Edges that a task gathers before it adds equal ones up; if more than half are left, it hands them on.
GATHERED = 1 << 20
#: Rows up to which the frequent phrases are sent to all tasks in joins.
JOIN_ROWS = 200_000

_ODD, _MIX, _LANG = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    return x * _MIX


def _there(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (bits[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1 == 1


class _Run:
    """The words of some texts with their languages, and the grams that begin at each word."""

    def __init__(self, batch: pa.RecordBatch):
        self.words: Words = split_words(batch.column(0), WORDS)
        coded = batch.column(1).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.words.row]
        of = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)[self.lang]
        self.hash = word_hashes(self.words.distinct)[self.words.ids]
        self.gram = _mixed(self.hash * _ODD + of * _LANG)  # the hash of the gram of one word
        last = np.flatnonzero(np.append(self.words.opens[1:], True)) if len(self.hash) else np.empty(0, np.int64)
        self.left = np.repeat(last, np.diff(last, prepend=-1)) + 1 - np.arange(len(self.hash))  # words to the end of the piece

    def grams(self, longest: int):
        """(size, hashes) from one word on: the hash of the gram of so many words that begins at each word, if it does."""
        gram = self.gram
        for size in range(1, longest + 1):
            if size > 1:
                gram = _mixed(gram[: len(gram) - 1] * _ODD + self.hash[size - 1 :] + np.uint64(size))
            yield size, gram, (gram >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def reach(self, tables: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """How long the gram at each word gets, as far as tables tell (words and pairs, longer grams); its hash; the spots of
        the grams that they don't tell, whose shorter ones are all frequent; and the spots of the words in frequent pairs.

        A word alone is told by the second table, which has only such words: others are in no phrase."""
        n = len(self.hash)
        size_of, hash_of, open_, paired = np.zeros(n, np.int64), np.zeros(n, np.uint64), [], np.empty(0, np.int64)
        able = np.ones(n, bool)
        for size, hashes, spots in self.grams(longest):
            at = self.left[: len(spots)] >= size
            if size > 1 and tables:
                at &= able[: len(spots)] & able[1 : len(spots) + 1]
            if size > 2 or not tables:
                told = len(tables) > 1
            else:
                at &= _there(tables[0], spots)
                told = True
            if size == 1:
                single = spots
            elif size == 2 and tables:
                paired = np.concatenate([single[:-1][at], single[1:][at]])
            if told:
                if size > 2:
                    at &= _there(tables[1], spots)
                size_of[: len(spots)][at], hash_of[: len(spots)][at] = size, hashes[at]
            else:
                open_.append(spots[at])
            if not tables and size == 2:
                break
            able = np.append(at, np.zeros(n - len(at), bool))
        if len(tables) > 1 and n:
            size_of[(size_of == 1) & ~_there(tables[1], single)] = 0
        return size_of, hash_of, open_, paired


def _count_buckets(tables, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slice, counts): one task's buckets of the grams that tables don't tell, for each slice of them, up to FULL."""
        total = np.zeros(1 << BUCKET_BITS, np.uint8)
        for batch in text_runs(batches, 0):
            _, _, open_, paired = _Run(batch).reach(tables.value, longest)
            for spots in open_:
                at, n = np.unique(spots, return_counts=True)
                total[at] = np.minimum(total[at] + n, FULL).astype(np.uint8)
            total[paired] = FULL
        parts = total.reshape(SLICES, -1)
        some = [i for i in range(SLICES) if parts[i].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], names=["slice", "counts"])

    return run


def _add_buckets(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slice, bits) from all tasks' counts: which buckets reach min_count."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint8)
                sums[i] = np.minimum(sums.get(i, 0) + part.astype(np.uint16), FULL)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(s >= min_count).tobytes() for s in sums.values()], pa.binary())], names=["slice", "bits"])

    return run


def frequent_buckets(texts: DataFrame, min_count: int, longest: int = LONGEST, tables: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """One bit for each bucket: whether its grams together occur min_count times. Always 2 MB. tables: what was found before."""
    sent = texts.sparkSession.sparkContext.broadcast(list(tables))
    counted = texts.mapInArrow(_count_buckets(sent, longest), "slice int, counts binary")
    bits = counted.repartition(SLICES, "slice").mapInArrow(_add_buckets(min_count), "slice int, bits binary").collect()
    out = np.zeros((SLICES, (1 << BUCKET_BITS) // SLICES // 8), np.uint8)
    for row in bits:
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _texts_of(words: pa.Array, ids: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    parts = [words.take(pa.array(ids[starts + k])) for k in range(size)]
    return (parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))).cast(pa.binary()).cast(pa.string())


EDGE = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])


def _added_up(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "size", "gram"]).aggregate([("n", "sum")]).rename_columns(EDGE.names)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _emit_edges(tables, longest: int):
    """A function from texts to (shard, edges): a task's edges, equal ones added up, in one packed table a shard; among them for
    each language the number of its words (size 0)."""

    def of_run(r: _Run) -> Iterator[tuple[np.ndarray, pa.Table]]:
        size_of, hash_of, _, _ = r.reach(tables.value, longest)
        for size in range(1, longest + 1):
            starts = np.flatnonzero(size_of == size)
            if not len(starts):
                continue
            key = r.lang[starts]
            for k in range(size):  # exact numbers for ever longer grams
                key = np.unique(key * len(r.words.distinct) + r.words.ids[starts + k], return_inverse=True)[1]
            _, one, n = np.unique(key, return_index=True, return_counts=True)
            at = starts[one]
            langs = pa.DictionaryArray.from_arrays(pa.array(r.lang[at]), pa.array(r.langs)).cast(pa.string())
            columns = [langs, pa.array(np.full(len(n), size, np.int32)), _texts_of(r.words.distinct, r.words.ids, at, size), pa.array(n)]
            yield (hash_of[at] % np.uint64(SLICES)).astype(np.int64), pa.table(columns, schema=EDGE)
        n = np.bincount(r.lang, minlength=len(r.langs))
        yield np.zeros(len(n), np.int64), pa.table([pa.array(r.langs, pa.string()), pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n)), pa.array(n.astype(np.int64))], schema=EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def out() -> pa.RecordBatch:
            whole = pa.concat_tables(held)
            shard = whole["shard"].to_numpy()
            order = np.argsort(shard, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
            parts = [_packed(whole.take(pa.array(order[a:b])).select(EDGE.names)) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(shard[order[cuts[:-1]]], pa.int32()), pa.array(parts, pa.binary())], names=["shard", "edges"])

        def merged() -> list[pa.Table]:
            return [pa.concat_tables(held).group_by(["shard", "lang", "size", "gram"]).aggregate([("n", "sum")]).rename_columns(["shard", *EDGE.names])]

        for batch in text_runs(batches, 0):
            r = _Run(batch)
            if not len(r.hash):
                continue
            for shard, table in of_run(r):
                held.append(table.add_column(0, "shard", pa.array(shard)))
                rows += table.num_rows
            if rows > GATHERED:
                held = merged()
                rows = held[0].num_rows
                if rows > GATHERED // 2:
                    yield out()
                    held, rows = [], 0
        if held:
            held = merged()
            yield out()

    return run


def _merge_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram, n) of whole shards; a shard has a share of the distinct edges, however often they occur."""
    held: dict[int, list[pa.Table]] = {}
    for batch in batches:
        for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts = held.setdefault(shard, [])
            parts.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
            if len(parts) > 16:
                held[shard] = [_added_up(parts)]
    for shard in sorted(held):
        yield from _added_up(held.pop(shard)).cast(EDGE).to_batches(max_chunksize=1 << 16)


def first_words(phrase: Column, k: int | Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), F.lit(k) if isinstance(k, int) else k)


def last_words(phrase: Column, k: int | Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), F.lit(-k) if isinstance(k, int) else -k)


def count_edges(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, size, gram, n): the graph of docs (text, lang), written to the shared folder: how often the longest gram that begins at
    a word is this one. Size 0 is a language's number of words. Words and phrases that surely occur less than min_count times
    are in no gram."""
    if not 1 <= min_count <= FULL:
        raise ValueError(f"min_count must be from 1 to {FULL}")
    ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    pairs = frequent_buckets(texts, min_count, longest)
    longer = frequent_buckets(texts, min_count, longest, (pairs,))
    tables = docs.sparkSession.sparkContext.broadcast([pairs, longer])
    found = texts.mapInArrow(_emit_edges(tables, longest), "shard int, edges binary")
    return stash(found.repartition(SLICES, "shard").mapInArrow(_merge_edges, "lang string, size int, gram string, n bigint"), "gram-edges")


def phrase_counts(edges: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, n): every phrase of 1 to longest words with n >= min_count, by the flow through its node: a phrase
    occurs as often as the grams of one word more begin with it, and grams end with it."""
    flow, levels, spent = None, [], []
    for size in range(longest, 0, -1):
        here = edges.filter(F.col("size") == size).select("lang", F.col("gram").alias("phrase"), "n")
        if flow is not None:
            through = flow.select("lang", first_words(F.col("phrase"), size).alias("phrase"), "n")
            here = stash(through.unionByName(here).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "gram-flow")
            spent.append(here)
        flow = here
        levels.append(flow.filter(F.col("n") >= min_count).select("lang", F.lit(size).alias("size"), "phrase", "n"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    found = stash(found, "phrases")
    discard(*spent)
    return found


def compact_paths(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, edge, head, place): each frequent edge with the first edge of its path and its place in it, from 0.

    A node with all its flow from one edge into one edge joins the two. Such paths cannot close, since each occurrence
    ends somewhere; so each edge finds its head by doubling steps, as many as the logarithm of the longest path."""
    edge = phrases.filter(F.col("size") == longest).select("lang", F.col("phrase").alias("edge"), "n")
    node = phrases.filter(F.col("size") == longest - 1).select("lang", F.col("phrase").alias("node"), "n")
    into = edge.select("lang", "n", last_words(F.col("edge"), longest - 1).alias("node"), F.col("edge").alias("before"))
    out = edge.select("lang", "n", first_words(F.col("edge"), longest - 1).alias("node"), F.col("edge"))
    links = node.join(into, ["lang", "node", "n"]).join(out, ["lang", "node", "n"]).select("lang", "edge", "before")
    at = edge.join(links, ["lang", "edge"], "left").select("lang", "edge", F.coalesce("before", "edge").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"))
    at = stash(at, "gram-paths")
    while True:
        up = at.select("lang", F.col("edge").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        on = stash(at.join(up, ["lang", "head"]).select("lang", "edge", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")), "gram-paths")
        discard(at)
        at = on
        if not on.filter("moved").limit(1).count():
            return at.drop("moved")


def passages(paths: DataFrame, phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, head, passage, n_words, n): the text of each compacted path and how often its edges occur, the least of them."""
    n = phrases.filter(F.col("size") == longest).select("lang", F.col("phrase").alias("edge"), "n")
    step = F.when(F.col("place") == 0, F.col("edge")).otherwise(last_words(F.col("edge"), 1))
    whole = paths.join(n, ["lang", "edge"]).groupBy("lang", "head").agg(F.array_sort(F.collect_list(F.struct("place", step.alias("words")))).alias("steps"), F.min("n").alias("n"))
    return whole.select("lang", "head", F.array_join(F.transform("steps", lambda s: s.words), " ").alias("passage"), (F.size("steps") + longest - 1).cast("long").alias("n_words"), "n")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The strongest phrases of each language: lang, rank, phrase, a, l, r, n, score, passage_words.

    Reads text and lang of docs (a null lang is 'und', a null text empty); other columns don't matter. A phrase of 2 to
    longest words is a candidate if it occurs a >= min_count times inside pieces. Its score is floor(1000 * a * n / (l * r))
    at the cut where that is least, ties to the first such cut; in 38 digits, so exact. A candidate goes if one that is
    a word longer, and so any longer one, holds it and occurs as often. Equal scores stand by a, then by phrase in byte order;
    so ranks are the same in every run. passage_words: the words of the compacted path that a phrase of longest words lies on, else
    its own. Repeated rows count each time, very long texts are read whole, an empty table gives no rows."""
    edges = count_edges(docs, min_count, longest)
    phrases = phrase_counts(edges, min_count, longest)
    paths = compact_paths(phrases, longest)
    lengths = paths.join(paths.groupBy("lang", "head").agg(F.max("place").alias("last")), ["lang", "head"]).select("lang", F.col("edge").alias("phrase"), (F.col("last") + longest).alias("passage_words"))
    total = edges.filter("size = 0").select("lang", F.col("n").alias("total"))
    held = phrases.filter(F.col("size") > 2)
    size = F.col("size") - 1
    inner = held.select("lang", "n", first_words(F.col("phrase"), size).alias("phrase")).unionByName(held.select("lang", "n", last_words(F.col("phrase"), size).alias("phrase"))).distinct()
    kept = phrases.filter("size > 1").join(inner, ["lang", "phrase", "n"], "left_anti")
    k = F.col("k")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size))).select("lang", "phrase", "size", F.col("n").alias("a"), "k", first_words(F.col("phrase"), k).alias("head"), last_words(F.col("phrase"), F.col("size") - k).alias("rest"))
    by = lambda part, count: phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
    cuts = join_checked(cuts, by("head", "l"), ["lang", "head"], rows=JOIN_ROWS)
    cuts = join_checked(cuts, by("rest", "r"), ["lang", "rest"], rows=JOIN_ROWS)
    cuts = join_checked(cuts, total, "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(15, 0)) * cast(total as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("total").alias("n"), "size")).alias("c")).select("lang", "phrase", "a", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = least.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    best = best.join(lengths, ["lang", "phrase"], "left")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.coalesce("passage_words", F.col("size").cast("long")).alias("passage_words"))
