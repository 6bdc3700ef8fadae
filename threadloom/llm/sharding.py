"""Sharding by sampled splitters: size-weighted key samples set range boundaries; overfull ranges are subdivided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import fresh, named, stash

SHARDS = 16
#: Keys sampled with a chance proportional to size, about, and the ranges they are cut into.
SAMPLE_KEYS = 50_000
RANGES = 256
#: A range with more than this many times the mean size or count is subdivided.
OVERFULL = 1.5
#: A piece of a range holds about so many rows, however large the input.
PIECE_ROWS = 20_000


def shard_key(text: Column, doc_id: Column) -> Column:
    """63 bits: the text's crc32, so that equal texts stand together, then 31 bits of the id's hash, so that a
    large group of copies can still be cut."""
    return F.shiftleft(F.crc32(F.coalesce(text, F.lit(""))), 31) + F.pmod(F.xxhash64(doc_id), F.lit(1 << 31))


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below key, by bisection."""
    if not splitters:
        return F.lit(0)
    steps, step = [], 1
    while step * 2 <= len(splitters):
        step *= 2
    while step:
        steps.append(step)
        step //= 2
    b = F.lit(splitters)
    return F.aggregate(
        F.lit(steps), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(b, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at)
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, name: str = "placement") -> DataFrame:
    """docs with a struct column named by name (one of that name is replaced): size, text_crc32, shard, slot.

    Law 'bytes': documents stand in the order of (key, id, size); a document goes to shard
    floor(bytes before it * shards / all bytes), so shards' sizes differ by one document at most, and each shard
    is one stretch of the order. slot counts from 0 within the shard. size is the text's bytes plus 1 (null: no
    bytes; very long: that many). Copies stand together, except where a shard ends within a group of them. Rows equal in id and text
    tie: which of them gets which place doesn't matter. An empty table stays empty.

    Splitters come from a sample whose chances are proportional to size; only RANGES quantiles of it reach the
    driver. A range over OVERFULL times the mean, or PIECE_ROWS, is cut evenly in key space. The exact places
    then need running sums within a piece only, plus the sums of the pieces before it, so the sample decides how
    the work is spread but not the result."""
    x, y = fresh(docs, "__shard"), fresh(docs, "__place")  # all that is worked out for a row lies in these two structs
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    own = [named(c) for c in docs.columns if c != name]
    keyed = docs.select(
        *own,
        F.struct(
            shard_key(F.col("text"), F.col("doc_id")).alias("key"),
            F.col("doc_id").alias("id"),
            size.alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("crc"),
        ).alias(x),
    )
    narrow = stash(keyed.select(f"{x}.*"), "shard-keys")
    totals = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    total, n = totals["bytes"], totals["n"]
    if not n:
        empty = F.struct(F.col(f"{x}.size").alias("size"), F.col(f"{x}.crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
        return keyed.select(*own, empty.alias(name))
    chance = F.col("size") * (SAMPLE_KEYS / total)
    drawn = F.pmod(F.xxhash64("key", "id", F.lit("splitters")), F.lit(1_000_003)) / 1_000_003.0
    marks = [i / RANGES for i in range(1, RANGES)]
    quantiles = narrow.filter(drawn < chance).agg(F.percentile_approx("key", marks, 10_000).alias("q")).first()["q"]
    splitters = sorted(set(quantiles or []))
    ranged = narrow.withColumn("r", _range_of(F.col("key"), splitters))
    seen = ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # RANGES rows
    mean = total / len(seen)
    cuts = {}
    for row in seen:
        fill = max(row["bytes"] / mean, 1.0)
        cuts[row["r"]] = (row["lo"], row["hi"] - row["lo"] + 1, max(1, -(-row["n"] // PIECE_ROWS), round(fill) if fill > OVERFULL else 1))
    order = [cuts.get(r, (0, 1, 1)) for r in range(len(splitters) + 1)]

    def piece(r: Column, key: Column) -> Column:
        lo, span, parts = (F.get(F.lit([o[i] for o in order]), r) for i in range(3))
        sub = F.when(parts > 1, F.floor((key - lo).cast("double") / span * parts).cast("int")).otherwise(F.lit(0))
        return F.struct(r.alias("r"), F.least(sub, parts - 1).alias("sub"))

    pieces = ranged.withColumn("piece", piece(F.col("r"), F.col("key"))).groupBy("piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # a row for each piece; what lies before a range is known from the ranges' own sums
    ahead, bytes_ahead, rows_ahead = {row["r"]: row for row in seen}, [0], [0]
    for r in range(len(splitters) + 1):
        bytes_ahead.append(bytes_ahead[-1] + (ahead[r]["bytes"] if r in ahead else 0))
        rows_ahead.append(rows_ahead[-1] + (ahead[r]["n"] if r in ahead else 0))
    line = Window.partitionBy("piece.r").orderBy("piece.sub").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, known: F.coalesce(F.sum(c).over(line), F.lit(0)) + F.get(F.lit(known), F.col("piece.r"))
    starts = stash(pieces.select(F.struct("piece", before("bytes", bytes_ahead).alias("bytes"), before("n", rows_ahead).alias("rows")).alias(y)), "shard-pieces")

    def placed(df: DataFrame) -> DataFrame:
        """df with x.to, the shard, and x.row, the place among all rows."""
        key = F.col(f"{x}.key")
        at = df.withColumn(x, F.col(x).withField("piece", piece(_range_of(key, splitters), key)))
        within = Window.partitionBy(f"{x}.piece").orderBy(f"{x}.key", f"{x}.id", f"{x}.size")
        upto = F.coalesce(F.sum(f"{x}.size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = at.withColumn(x, F.struct(f"{x}.*", upto.alias("upto"), (F.row_number().over(within) - 1).alias("row")))
        at = at.join(starts, F.col(f"{x}.piece") == F.col(f"{y}.piece"))
        to = F.expr(f"cast((({x}.upto + {y}.bytes) * {shards}) div {total} as int)")
        return at.withColumn(x, F.struct(f"{x}.size", f"{x}.crc", (F.col(f"{x}.row") + F.col(f"{y}.rows")).alias("row"), to.alias("to")))

    firsts = placed(narrow.select(F.struct("key", "id", "size", "crc").alias(x))).groupBy(f"{x}.to").agg(F.min(f"{x}.row").alias("first")).collect()  # a row for each shard
    first = F.lit([next((r["first"] for r in firsts if r["to"] == s), 0) for s in range(shards)])
    done = placed(keyed)
    slot = (F.col(f"{x}.row") - F.get(first, F.col(f"{x}.to"))).cast("long")
    place = F.struct(F.col(f"{x}.size").alias("size"), F.col(f"{x}.crc").alias("text_crc32"), F.col(f"{x}.to").alias("shard"), slot.alias("slot"))
    return done.select(*own, place.alias(name))
