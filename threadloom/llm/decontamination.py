"""Benchmark decontamination by winnowed k-gram fingerprints, joined and then extended word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import fresh, hot_keys, join_checked, join_split, small, stash
from threadloom.llm.text import LETTER_WORD, LETTER_WORD_ANY_CASE, ascii_lower, gram_hashes, let, words

WINDOW = 10
GRAM = 5
CHUNK = 96
#: Rows up to which fingerprints, each with the words around it, may be broadcast; their bytes are checked too.
FINGERPRINT_ROWS = 1_000_000


def winnow(hashes: Column, window: int) -> Column:
    """The least hash of every run of so many consecutive hashes; empty where there are fewer."""
    if window == 1:
        return hashes
    return let(
        hashes,
        lambda h: F.slice(
            F.transform(h, lambda x, i: F.least(x, *[F.get(h, i + d) for d in range(1, window)])),
            1,
            F.greatest(F.size(h) - (window - 1), F.lit(0)),
        ),
    )


def _scheme(length: int) -> tuple[int, int]:
    """(k, hashes per winnowing window) that catch every shared run of length words."""
    k = min(GRAM, length)
    return k, length - k + 1


def item_classes(benchmark: DataFrame) -> DataFrame:
    """Items by word sequence: (cls, words, items), with items the sorted distinct ids as strings."""
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words(ascii_lower(F.col("text")), LETTER_WORD).alias("words"))
        .filter((F.size("words") > 0) & F.col("item").isNotNull())
        .withColumn("cls", F.sha2(F.array_join("words", " "), 256))
        .groupBy("cls")
        .agg(F.first("words").alias("words"), F.array_sort(F.collect_set("item")).alias("items"))
    )


def contaminated_spans(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key..., start, stop, cls): word spans of docs that hold a whole window of an item of that class.

    docs: key columns and tokens, an array of words. A document is cut into chunks that overlap by
    WINDOW - 1 words, so that every window lies whole in the chunk in which it starts and a very long text is
    many small rows."""
    keys = [c for c in docs.columns if c != "tokens"]
    sized = classes.withColumn("m", F.least(F.lit(WINDOW), F.size("words")))
    lengths = sorted(r.m for r in sized.select("m").distinct().collect())  # at most WINDOW values
    empty = docs.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("cls")).limit(0)
    if not lengths:
        return empty

    def prints(tokens: Column, m: int) -> Column:
        k, w = _scheme(m)
        return F.transform(F.array_distinct(winnow(gram_hashes(tokens, k), w)), lambda h: F.struct(F.lit(m).alias("m"), h.alias("h")))

    item_prints = None
    for m in lengths:
        k, w = _scheme(m)
        # a fingerprint comes with the words that a window around it can reach, not with its whole item; places that
        # look alike, as in an item that repeats itself, are one row
        words_, q = F.col("words"), F.col("q")
        start = F.greatest(F.lit(0), q - (m - k))
        at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(CHUNK))).alias("at")
        own = (
            sized.filter(F.col("m") == m)
            .select("cls", "words", at)
            .select("cls", F.slice(F.col("words"), F.col("at") + 1, CHUNK + 2 * WINDOW).alias("words"))  # every window lies whole in a chunk
            .select("cls", "words", gram_hashes(words_, k).alias("g"))
            .select("cls", "words", F.array_distinct(winnow(F.col("g"), w)).alias("f"), F.posexplode("g").alias("q", "h"))
            .filter(F.array_contains("f", F.col("h")))
            .select("cls", F.lit(m).alias("m"), F.lit(k).alias("k"), "h", (q - start).alias("q"), F.slice(words_, start + 1, q - start + m).alias("item_words"))
            .distinct()
        )
        item_prints = own if item_prints is None else item_prints.unionByName(own)
    item_prints = stash(item_prints, "fingerprints")

    step = F.lit(CHUNK)
    chunks = docs.select(
        *keys,
        F.explode(
            F.when(F.size("tokens") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / step).cast("int")), lambda c: F.struct((c * step).alias("at"), F.slice("tokens", c * step + 1, CHUNK + WINDOW - 1).alias("t"))))
        ).alias("c"),
    ).select(*keys, "c.at", F.col("c.t").alias("t"))
    prints_of = F.explode(F.concat(*[prints(F.col("t"), m) for m in lengths])).alias("p")
    hot = None
    if not small(item_prints, FINGERPRINT_ROWS):
        # too many to broadcast: first find, by fingerprints alone, the few chunks that have any; only these are shuffled with their
        # words. What very many chunks have, a passage that all copy or a word that is an item, is spread over several tasks
        seen = chunks.select(*keys, "at", prints_of).select(*keys, "at", "p.m", "p.h")
        sought = stash(item_prints.select("m", "h").distinct(), "sought")
        hot = stash(hot_keys(seen, ["m", "h"]).join(sought, ["m", "h"], "left_semi"), "hot")
        met = join_split(seen, sought, ["m", "h"], [*keys, "at"], "left_semi", hot).select(*keys, "at").distinct()
        met = stash(met.select(F.struct(*keys, "at").alias("met")), "met-chunks")
        same = F.lit(True)
        for c in (*keys, "at"):
            same = same & F.col(c).eqNullSafe(F.col(f"met.{c}"))
        chunks = join_checked(chunks, met, same, "left_semi")
    doc_prints = chunks.select(*keys, "at", F.array_join("t", " ").alias("chunk"), prints_of).select(*keys, "at", "chunk", "p.m", "p.h")
    if hot is None:
        met = doc_prints.join(F.broadcast(item_prints), ["m", "h"])  # its rows and bytes were checked above
    else:
        met = join_split(doc_prints, item_prints, ["m", "h"], [*keys, "at"], hot=hot)

    t, iw = F.col("t"), F.col("item_words")
    grams = met.withColumn("t", F.split("chunk", " ")).withColumn("g", F.slice(iw, F.col("q") + 1, F.col("k")))
    places = grams.withColumn(
        "p",
        F.explode(F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i + F.col("k") <= F.size(t)) & (F.slice(t, i + 1, F.col("k")) == F.col("g")))),
    )
    reach = F.col("m") - F.col("k")

    def run(step: int, doc_from: Column, item_from: Column) -> Column:
        """How many words agree going on from both places, m - k at most."""
        differs = lambda d: ~F.coalesce((F.get(t, doc_from + d * step) == F.get(iw, item_from + d * step)), F.lit(False))
        return F.array_min(F.filter(F.sequence(F.lit(0), reach), lambda d: (d == reach) | differs(d)))

    p, q, k = F.col("p"), F.col("q"), F.col("k")
    return (
        places.withColumn("left", run(-1, p - 1, q - 1))
        .withColumn("right", run(1, p + k, q + k))
        .filter(F.col("left") + k + F.col("right") >= F.col("m"))
        .select(*keys, (F.col("at") + p - F.col("left")).alias("start"), (F.col("at") + p + k + F.col("right")).alias("stop"), "cls")
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    Reads doc_id, text and item_id, text; other columns don't matter. A null or empty text has no words; an
    very long text is read in overlapping chunks; an item without words or id is no item. Rows that share an id are judged by their own texts; repeated rows
    each get the same result. An empty benchmark finds nothing. Items with equal words are joined as one
    class, so copies in the benchmark do not multiply the matches."""
    tokens = words(ascii_lower(F.col("text")), LETTER_WORD)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    classes = item_classes(benchmark)
    spans = contaminated_spans(keyed.select("doc_id", "text_hash", tokens.alias("tokens")), classes)
    per_class = spans.groupBy("doc_id", "text_hash", "cls").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    found = (
        join_checked(per_class, classes.select("cls", "items"), "cls")
        .groupBy("doc_id", "text_hash")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select(
            F.col("doc_id").alias("k_id"),
            F.col("text_hash").alias("k_hash"),
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.stop - 1))))).cast("long").alias("n_hit"),
            "items",
        )
    )
    counted = keyed.select("doc_id", "text_hash", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(LETTER_WORD_ANY_CASE)).cast("long").alias("n_words"))
    joined = counted.join(found, counted.doc_id.eqNullSafe(found.k_id) & (counted.text_hash == found.k_hash), "left")
    return joined.select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of a benchmark item; columns as they were.

    Rows are judged by their own texts, repeated rows alike; null and empty texts hold nothing and stay, very long ones
    are read in overlapping chunks. An empty benchmark drops nothing; an empty table stays empty."""
    tokens = words(ascii_lower(F.col("text")), LETTER_WORD)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens.alias("tokens"))
    k_id, k_hash = fresh(docs, "k_id"), fresh(docs, "k_hash")
    hits = contaminated_spans(keyed, item_classes(benchmark)).select(F.col("doc_id").alias(k_id), F.col("text_hash").alias(k_hash)).distinct()
    hits = stash(hits, "contaminated")  # ids alone: the texts stay where they are unless there are very many
    return join_checked(docs, hits, docs.doc_id.eqNullSafe(hits[k_id]) & (F.xxhash64(docs["text"]) == hits[k_hash]), "left_anti")
