"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, with links confirmed on full sets.

A signature has SLOTS minima of b = 16 bits each. It is split into CHUNKS chunks of CHUNK_SLOTS slots. By the
pigeonhole rule two signatures that differ in at most 2 * CHUNKS - 1 slots have a chunk with at most one
differing slot, so each chunk is indexed once for every slot that may be in error, by the others' values: all
pairs under that signature distance share a key. At similarity 0.8 the chance that no chunk is so close is
about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from threadloom.llm.text import SPACE_WORD, ascii_lower, let, no_longs, words
from threadloom.plans.components import connected_components
from threadloom.session import discard, fresh, hot_keys, join_checked, join_split, named, ship, stash

CHUNKS, CHUNK_SLOTS = 8, 4
SLOTS = CHUNKS * CHUNK_SLOTS
SEED = 20240229
PERCENT = 80
#: Words of a shingle where a corpus is cleaned; op6's contract has 2, the default of the functions below it.
STAGE_WORDS = 5
#: Ids of up to so many documents (8 bytes each) may be broadcast.
ID_ROWS = 500_000
#: What so many members of a center have, and one in so many of them, comes late in the order of prefixes.
MANY, MANY_SHARE = 4, 50
#: Shingles that are hashed at once in a Python worker.
BLOCK = 1 << 18


def shingle_set(text: Column, n: int = 2) -> Column:
    """Distinct 64-bit hashes of the n-word shingles; of the whole sequence where it is shorter; null if no word."""
    tokens = words(ascii_lower(text), SPACE_WORD)

    def grams(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        pairs = let(h, lambda a: F.slice(F.transform(a, lambda x, i: F.xxhash64(*[x] + [F.get(a, i + d) for d in range(1, n)])), 1, F.size(a) - (n - 1)))
        return F.when(F.size(w) >= n, F.array_distinct(pairs)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(no_longs())

    return let(tokens, grams)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles) -> (doc_id, n_shingles, print, keys)."""
    import hashlib

    rng = np.random.default_rng(SEED)
    mul = rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
    for batch in batches:
        lists = batch.column(1)
        flat = np.asarray(lists.flatten()).view(np.uint64)
        ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
        n = len(batch)
        sig = np.zeros((n, SLOTS), np.uint64)
        first = 0
        while first < n:  # documents of at most BLOCK shingles together, or one that is longer
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
            full = [i for i in range(first, last) if ends[i + 1] > ends[i]]
            if full:
                part, starts = flat[ends[first] : ends[last]], ends[full] - ends[first]
                for s in range(SLOTS):
                    v = part * mul[s] + add[s]
                    v ^= v >> np.uint64(29)
                    sig[full, s] = np.minimum.reduceat(v, starts)
            first = last
        low = (sig * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        keys = np.zeros((n, SLOTS), np.uint64)
        for c in range(CHUNKS):
            for wrong in range(CHUNK_SLOTS):
                key = np.full(n, c * CHUNK_SLOTS + wrong, np.uint64)
                for s in range(CHUNK_SLOTS):
                    if s != wrong:
                        key = (key << np.uint64(16)) | low[:, c * CHUNK_SLOTS + s]
                keys[:, c * CHUNK_SLOTS + wrong] = key
        prints = [hashlib.blake2b(np.sort(flat[ends[i] : ends[i + 1]]).tobytes(), digest_size=16).digest() for i in range(n)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(ends), pa.int64()),
                pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * SLOTS + 1, SLOTS), pa.int32()), pa.array(keys.view(np.int64).ravel())),
            ],
            names=["doc_id", "n_shingles", "print", "keys"],
        )


def signatures(docs: DataFrame, n: int = 2) -> DataFrame:
    """(doc_id, n_shingles, print, keys) of documents (doc_id, text); print names the set of n-word shingles."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", shingle_set(F.col("text"), n).alias("s")).mapInArrow(_signatures, f"doc_id {kind}, n_shingles long, print binary, keys array<long>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a stashed table, with the sizes of their full sets and of what these share.

    A document that has very many pairs meets them in blocks."""
    sa = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    sb = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = join_split(pairs.select("a", "b"), sa, ["a"], ["b"]).join(sb, "b")
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))


def _linked() -> Column:
    return F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * PERCENT


def unsettled_pairs(tried: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of members of one center that may be linked and are not in one component yet.

    tried: (a, b, na, nb, shared) of centers a and members b. Let D be what a member's set and its center's do
    not share. Two members x, y differ in |Dx| + |Dy| - 2 |Dx and Dy| shingles, and are linked if and only if
    that is at most (|x| + |y|) / 9 (for PERCENT = 80). If x is not linked to the center this asks for at least
    one common element of Dx and Dy, and mostly for many: with G = 9 |D| - size, for (Gx + Gy) / 18. So the
    D are joined by prefixes: in any one order, sets with o common elements share one among the first |D| - o + 1
    of both. Near copies with edits of their own thus never meet, however many they are, and no pair
    that could be linked is left out."""
    slack = (100 - PERCENT) / (100 + PERCENT)  # of both sizes together, what may differ
    per = round(1 / slack)
    assert abs(per * slack - 1) < 1e-9
    c = parts.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    hot = stash(hot_keys(tried, ["a"]), "hot")  # centers whose members are spread over several tasks in all that follows
    marked = join_split(tried.join(c, "b", "left"), c.select(F.col("b").alias("a"), F.col("cb").alias("ca")), ["a"], ["b"], "left", hot)
    marked = stash(marked.withColumn("cb", F.coalesce("cb", "b")).withColumn("ca", F.coalesce("ca", "a")), "marked")
    centers = marked.groupBy("a").agg(F.min(F.least("ca", "cb")).alias("lo"), F.max(F.greatest("ca", "cb")).alias("hi")).filter("lo <> hi").select("a")
    apart_by = F.col("na") + F.col("nb") - 2 * F.col("shared")
    open_ = join_split(marked, centers, ["a"], ["b"], hot=hot).select("a", "b", "cb", _linked().alias("linked"), (per * apart_by - F.col("nb")).cast("long").alias("g"), (per * apart_by + F.col("nb")).cast("long").alias("h"), "na")
    # linked sets have |D| so near one another that their ranges g to h overlap: only members that share a stretch
    # of such ranges with one of another component, one of both not linked to the center, can still matter
    ranged = open_.withColumn("bin", F.explode(F.sequence(F.floor(F.col("g") / F.col("na")), F.floor(F.col("h") / F.col("na")))))
    mixed = ranged.groupBy("a", "bin").agg(F.min("cb").alias("lo"), F.max("cb").alias("hi"), F.min("linked").alias("all_linked")).filter("lo <> hi and not all_linked").select("a", "bin")
    open_ = stash(ranged.join(mixed, ["a", "bin"]).select("a", "b", "cb", "linked", "g").distinct(), "ranges")
    bounds = open_.groupBy("a").agg(F.min("g").alias("g_any"), F.min(F.when(~F.col("linked"), F.col("g"))).alias("g_out")).filter("g_out is not null")
    ranged = open_
    open_ = stash(join_split(open_, bounds, ["a"], ["b"], hot=hot).select("a", "b", "cb", "g", "linked", "g_any", "g_out"), "open")
    discard(marked, ranged)
    sa = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    sb = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    split = join_split(open_, sa, ["a"], ["b"], hot=hot).join(sb, "b").withColumn("own", F.array_except("sb", "sa")).withColumn("lack", F.array_except("sa", "sb")).drop("sa", "sb")
    split = stash(split, "differing")
    # the order: what few members have, what many have by how many, what the members lack. What many have is a
    # short list for each center, as each entry takes a fair share of its members
    n = split.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    often = split.select("a", F.explode("own").alias("item")).groupBy("a", "item").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= MANY)
    often = often.join(n, "a").filter(F.col("df") * MANY_SHARE >= F.col("members"))
    often = often.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "item"))), lambda x: x.item).alias("often"))
    listed = join_split(split, often, ["a"], ["b"], "left", hot).withColumn("often", F.coalesce("often", no_longs()))
    ordered = F.concat(F.sort_array(F.array_except("own", "often")), F.array_intersect("often", "own"), F.sort_array("lack"))
    differing = stash(listed.withColumn("d", ordered).drop("own", "lack", "often").withColumn("nd", F.size("d")), "differing")
    discard(open_, split)

    def prefix(df: DataFrame, partner: str) -> DataFrame:
        o = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col(partner)) / (2 * per)))
        first = F.slice("d", 1, F.greatest(F.lit(0), F.col("nd") - o + 1).cast("int"))
        each = df.select("a", "b", "cb", "g", "nd", F.posexplode(first).alias("pos", "item"))
        return each.select("a", "b", "cb", "g", "item", (F.col("nd") - F.col("pos")).alias("left"))

    x, y = prefix(differing.filter(~F.col("linked")), "g_any").alias("x"), prefix(differing, "g_out").alias("y")
    need = F.ceil((F.col("x.g") + F.col("y.g")) / (2 * per))
    # at the first element that two sets share, both must have enough left, it included
    met = (F.col("x.a") == F.col("y.a")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.cb") != F.col("y.cb")) & (need <= F.least("x.left", "y.left"))
    return x.join(y, met).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; by shingles of n words.

    Reads doc_id, of any type that has an order, and text, whole however long; other columns don't matter. Texts without words have no set, stay alone and are
    kept. Rows that share an id count as one document, linked by any of its texts. A null id is linked with
    nothing: component_id null, kept. Empty input gives no rows.

    1. Rows with equal sets collapse to one class, named by its least id, so copies never meet one another.
    2. Classes meet by key. Each key's most central member (the one with the most company over all keys, so
       that near copies agree on it) is compared with all others: as many pairs as members, not their square.
    3. Confirmed links give components. A center whose members are all in one component is settled.
    4. Of the others, unsettled_pairs() gives the pairs of members that can still be linked; all are compared.
    So no pair of a shared key is left out unless it is already connected or can't be similar enough."""
    base = docs.select("doc_id", "text")
    sigs = stash(signatures(base, n), "signatures")
    usable = sigs.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stash(usable.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select("rep", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("company")).filter("company > 1")
    live = keyed.join(shared, "key")
    central = live.groupBy("rep").agg(F.sum("company").alias("weight"))
    live = stash(live.select("key", "rep").join(central, "rep"), "keys")

    reps = live.select(F.col("rep").alias("id")).distinct()
    wanted = join_checked(base.withColumnRenamed("doc_id", "id"), reps, "id", "left_semi", ID_ROWS)
    sets = stash(wanted.select("id", shingle_set(F.col("text"), n).alias("s")), "sets")

    pivots = live.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("light"), "rep")).alias("p")).select("key", F.col("p.rep").alias("a"))
    met = join_split(live, pivots, ["key"], ["rep"])
    pairs = stash(met.filter(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct(), "pairs")
    discard(live)
    tried = stash(compared(pairs, sets), "tried")
    discard(pairs)
    links = tried.filter(_linked()).select("a", "b")
    parts = connected_components(links)
    maybe = stash(unsettled_pairs(tried, parts, sets), "unsettled")
    more = stash(compared(maybe, sets).filter(_linked()).select("a", "b"), "links")
    discard(sets, maybe)
    if more.limit(1).count():
        parts = connected_components(links.unionByName(more))

    named = classes.select("print", "rep").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("found"))
    lonely = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = sigs.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    component = F.when(lonely, F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = STAGE_WORDS) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the least id; columns as they were.

    Documents are compared by shingles of n words. Of rows that share a kept id one stays, the one whose text comes
    first in order (of equal texts, the one with the least hash of all columns that can be hashed). Rows without an
    id are kept, null and empty texts too. Empty input stays empty."""
    verdict = near_duplicates(docs, n)
    gone_id = fresh(docs, "gone_id")
    gone = stash(verdict.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    kept = join_checked(docs, gone, docs["doc_id"] == gone[gone_id], "left_anti", ID_ROWS)
    again = stash(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 and doc_id is not null").select(F.col("doc_id").alias(gone_id)), "again")
    if again.limit(1).count() == 0:
        return kept
    repeated = F.col(f"{gone_id}").isNotNull()
    marked = join_checked(kept, again, kept["doc_id"] == again[gone_id], "left", ID_ROWS)
    own = [named(c) for c in docs.columns]
    plain = [named(f.name) for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    first = F.min_by(F.struct(*own), F.struct(F.coalesce(F.col("text"), F.lit("")), F.xxhash64(*plain)))
    single = marked.filter(repeated).groupBy(gone_id).agg(first.alias("row")).select("row.*")
    return marked.filter(~repeated).select(*own).unionByName(single)
