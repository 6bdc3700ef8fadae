"""Quality by interpolated modified Kneser-Ney models of characters, one a language, trained on trusted text.

Characters are taken as they are and the models have ORDER characters a gram, so what is counted grows with the
corpus. Texts are read twice. First each task counts the distinct grams of its documents, with how often trusted
ones hold them; these counts are sharded by gram and joined, order by order, with the sums of their contexts and
with the lower orders, which gives a cost, -log p, for every gram of the corpus. Then each document's distinct grams
are joined with these costs and summed up: a perplexity for every document. The most frequent grams, HOT_GRAMS at
most, are broadcast, so that a gram that all documents hold is no hot key; the others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import join_checked, ship, stash

ORDER = 5
QUANTILE = 0.99
#: Of so many trusted documents one, by its id's crc32, sets the threshold; the others train the model.
CALIBRATION = 3
#: Standard errors of a text's own mean that are taken off before it is judged, so that short texts need
#: stronger evidence.
MARGIN = 2.0
#: Costs are compared in steps of 1 / STEPS.
STEPS = 1000
#: Grams, 16 bytes each, that may be broadcast.
HOT_GRAMS = 1 << 20
#: Ids of up to so many trusted documents (8 bytes each) may be broadcast.
ID_ROWS = 500_000
#: Stands before a text; a zero character counts as MARK.
START, MARK = 2, 1
#: Characters of a text that are handled at once, and that are counted together.
PIECE = 1 << 20


def language_seed(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def code_points(text: str) -> Iterator[np.ndarray]:
    """A text's code points in pieces, each after the ORDER - 1 points before it (START at the text's beginning)."""
    before = np.full(ORDER - 1, START, np.uint32)
    for at in range(0, len(text), PIECE):
        own = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([before, np.where(own == 0, MARK, own)]).astype(np.uint32)
        before = points[len(points) - ORDER + 1 :]
        yield points


def gram_keys(points: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64-bit keys of the grams, one for each character, of a language."""
    n = len(points) - ORDER + 1
    h = np.full(n, seed, np.uint64)
    for k in range(ORDER):
        h ^= points[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, fits, text) -> (key, lang, gram, n, c): occurrences of grams in all texts and in those that train."""
    held: dict[str, tuple[list[np.ndarray], list[np.ndarray], list[int]]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        points, weights, lengths = held.pop(lang)
        keys = np.concatenate([gram_keys(p, language_seed(lang)) for p in points])
        starts = np.concatenate([np.arange(n) + at for n, at in zip(lengths, np.cumsum([0, *(len(p) for p in points)]), strict=False)])
        flat, fits = np.concatenate(points), np.repeat(np.array(weights, np.int64), lengths)
        which, distinct = pd.factorize(keys)
        n = np.bincount(which)
        place = np.empty(len(distinct), np.int64)
        place[which] = starts  # any of a gram's places
        grams = flat[place[:, None] + np.arange(ORDER)].astype(np.uint32)
        strings = np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel()
        c = np.bincount(which, weights=fits, minlength=len(distinct)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(distinct.view(np.int64)), pa.array([lang] * len(distinct), pa.string()), pa.array(strings, pa.string()), pa.array(n.astype(np.int64)), pa.array(c)],
            names=["key", "lang", "gram", "n", "c"],
        )

    for batch in batches:
        langs, fits, texts = batch.columns
        for at in range(0, len(batch), 256):  # as Python strings, few at a time
            for lang, fit, text in zip(*(x.slice(at, 256).to_pylist() for x in (langs, fits, texts)), strict=True):
                for points in code_points(text or ""):
                    own = held.setdefault(lang, ([], [], []))
                    own[0].append(points)
                    own[1].append(fit)
                    own[2].append(len(points) - ORDER + 1)
                    if sum(own[2]) >= 2 * PIECE:
                        yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(key, lang, gram, n, c) of docs (lang, fits, text): each distinct gram of a language with its counts."""
    ship(docs.sparkSession)
    counted = docs.select("lang", F.col("fits").cast("int").alias("fits"), "text").mapInArrow(_count, "key long, lang string, gram string, n long, c long")
    return counted.groupBy("key", "lang", "gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the discounts of modified Kneser-Ney from how many of a level's counts are 1, 2, 3, 4."""
    n = level.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)

    def d(k: int, plain: float) -> Column:
        raw = k - (k + 1) * y * F.col(f"n{k + 1}") / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}"))
        return F.when(usable, F.least(F.greatest(raw, F.lit(0.05)), F.lit(k - 0.05))).otherwise(plain).alias(f"d{k}")

    return n.select("lang", d(1, 0.5), d(2, 0.75), d(3, 0.9))


def gram_costs(grams: DataFrame) -> DataFrame:
    """(key, n, cost) of grams (key, lang, gram, n, c): -log p of a gram's last character after the others.

    A gram that no trusted text holds gets what its context and shorter grams give it. Below the single characters
    stands the even chance of each that was seen and of one more. A language that nothing trains has null costs."""
    levels = {ORDER: grams.select("lang", "gram", "c")}
    for k in range(ORDER - 1, 0, -1):  # in how many contexts a shorter gram was seen
        wider = levels[k + 1]
        levels[k] = stash(wider.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), f"kn-level{k}")
    alphabet = levels[1].groupBy("lang").agg(F.sum((F.col("c") > 0).cast("long")).alias("kinds"))
    lower = join_checked(levels[1], alphabet, "lang").select("lang", "gram", F.when(F.col("kinds") > 0, 1.0 / (F.col("kinds") + 1)).alias("p"))
    for k in range(1, ORDER + 1):
        c = F.col("c")
        level = join_checked(levels[k], discounts(levels[k]), "lang")
        taken = F.when(c == 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select("lang", "gram", "c", taken.alias("taken"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2 if k > 1 else 1, max(1, k - 1)).alias("short"))
        contexts = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("taken").alias("left"))
        # single characters have one context a language: few rows, but a hot key if it were shuffled
        level = join_checked(level, contexts, ["lang", "context"]) if k == 1 else level.join(contexts, ["lang", "context"])
        level = level.join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("p_lower")), ["lang", "short"])
        seen = F.when(F.col("total") > 0, (c - F.col("taken")) / F.col("total")).otherwise(0.0)
        back = F.when(F.col("total") > 0, F.col("left") / F.col("total")).otherwise(1.0)
        lower = level.select("lang", "gram", (seen + back * F.col("p_lower")).alias("p"))
        if k < ORDER:
            lower = stash(lower, f"kn-p{k}")
    return grams.select("key", "lang", "gram", "n").join(lower, ["lang", "gram"]).select("key", "n", (-F.log("p")).alias("cost"))


def hottest(costs: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """costs in two: the most frequent grams, at most so many, and the others."""
    most = HOT_GRAMS if most is None else most
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in costs.groupBy(step.alias("step")).count().collect()), reverse=True)  # 512 rows at most
    cut, total = 1 << 30, 0
    for s, count in sizes:
        total += count
        if total > most:
            break
        cut = s
    return costs.filter(step >= cut).select("key", "cost"), costs.filter(step < cut).select("key", "cost")


def key_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[head], np.diff(np.append(head, len(keys)))


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, lang, text) -> (doc_id, hash, key, times) for each distinct gram of a document."""

    def rows(batch: pa.RecordBatch, index: list[int], keys: list[np.ndarray], times: list[np.ndarray], parts: list[int]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.array(index, np.int64), parts))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(times).astype(np.int64))],
            names=["doc_id", "hash", "key", "times"],
        )

    for batch in batches:
        index, keys, times, parts = [], [], [], []
        for at in range(0, len(batch), 256):
            for i, (lang, text) in enumerate(zip(batch.column(2).slice(at, 256).to_pylist(), batch.column(3).slice(at, 256).to_pylist(), strict=True)):
                for points in code_points(text or ""):
                    k, t = key_counts(gram_keys(points, language_seed(lang)))
                    index.append(at + i)
                    keys.append(k)
                    times.append(t)
                    parts.append(len(k))
                    if sum(parts) >= PIECE:
                        yield rows(batch, index, keys, times, parts)
                        index, keys, times, parts = [], [], [], []
        if index:
            yield rows(batch, index, keys, times, parts)


def perplexities(docs: DataFrame, costs: DataFrame) -> DataFrame:
    """(doc_id, hash, nll, deviation) of docs (doc_id, hash, lang, text) that have text: the mean cost of a document's
    characters and the standard deviation of their costs. Rows equal in id and hash give one row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", "hash", "lang", "text").mapInArrow(_document_grams, f"doc_id {kind}, hash long, key long, times long")
    hot, cold = hottest(costs)
    # one pass over the texts: what hot grams cost is added up at once, and what is left is a row for each cold gram
    x, t = F.col("cost"), F.col("times")
    met = held.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    parts = met.groupBy("doc_id", "hash", F.when(F.col("hot").isNull(), F.col("key")).alias("cold"))
    parts = stash(parts.agg(F.sum(t).alias("t"), F.sum(t * x).alias("s"), F.sum(t * x * x).alias("q")), "kn-parts")
    rest = parts.filter("cold is not null").join(cold.hint("merge"), F.col("cold") == F.col("key"))
    rest = rest.select("doc_id", "hash", "t", (F.col("t") * x).alias("s"), (F.col("t") * x * x).alias("q"))
    parts = parts.filter("cold is null").drop("cold").unionByName(rest).groupBy("doc_id", "hash").agg(*[F.sum(c).alias(c) for c in ("t", "s", "q")])
    mean = F.col("s") / F.col("t")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("t") - mean * mean))
    return parts.select("doc_id", "hash", mean.alias("nll"), deviation.alias("deviation"))


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold): the step of the ceil((k + 1) * quantile)-th least of a language's k rows (lang, step).

    By that rank, not k * quantile, a new document like these stays with the chance quantile or more; where
    k is too small to promise it, there is no row. Steps, not rows, are put in order, and they are few."""
    sizes = scored.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    k = F.sum("n").over(Window.partitionBy("lang"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sizes.select("lang", "step", upto.alias("upto"), F.ceil((k + 1) * quantile - 1e-9).alias("rank"))
    return ranked.filter("upto >= rank").groupBy("lang").agg(F.min("step").alias("threshold"))


def classify_quality(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_grams, perplexity, threshold (a perplexity), kept.

    docs: doc_id, text, lang; other columns don't matter. trusted_ids: doc_id of trusted documents (repeats
    don't matter). Of these, one in CALIBRATION is kept from training and sets its language's threshold: the quantile
    of mean costs less MARGIN standard errors, by which every document is judged. A document is kept if it is within
    the threshold or its language has none, because too few or no documents are trusted; null is a language. A null
    or empty text has no grams and no perplexity and is not kept. Very long texts are read whole, in pieces.
    Rows that share an id are judged by their own texts, repeated rows alike. Empty input gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    ids = trusted_ids.select("doc_id").distinct().withColumn("trusted", F.lit(True))
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    calibrates = F.crc32(F.col("doc_id").cast("string")) % CALIBRATION == 0
    marked = join_checked(docs.select("doc_id", F.xxhash64("lang", "text").alias("hash"), "lang", "text"), ids, "doc_id", "left", ID_ROWS)
    marked = marked.select("doc_id", "hash", lang.alias("lang"), F.coalesce("trusted", F.lit(False)).alias("trusted"), calibrates.alias("calibrates"), "text")
    fitting = marked.select("lang", (F.col("trusted") & ~F.col("calibrates")).alias("fits"), "text")
    costs = stash(gram_costs(stash(corpus_grams(fitting), "kn-grams")), "kn-costs")
    found = perplexities(marked.select("doc_id", "hash", "lang", "text"), costs).withColumnsRenamed({"doc_id": "k_id", "hash": "k_hash"})
    plain = marked.select("doc_id", "hash", "lang", "trusted", "calibrates", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_grams"))
    step = F.ceil((F.col("nll") - MARGIN * F.col("deviation") / F.sqrt("n_grams")) * STEPS)
    scored = stash(plain.join(found, plain.doc_id.eqNullSafe(found.k_id) & (plain.hash == found.k_hash), "left").withColumn("step", step).drop("k_id", "k_hash"), "kn-scored")
    limits = thresholds(scored.filter("trusted and calibrates and step is not null").select("lang", "step"), quantile)
    judged = join_checked(scored, limits, "lang", "left")
    fits = F.coalesce(F.col("step") <= F.col("threshold"), F.lit(True))
    n = F.col("n_grams")
    named = F.when(F.col("lang") != "-", F.expr("substring(lang, 2)"))
    return judged.select("doc_id", named.alias("lang"), n, F.exp("nll").alias("perplexity"), F.exp(F.col("threshold") / STEPS).alias("threshold"), ((n > 0) & fits).alias("kept"))
