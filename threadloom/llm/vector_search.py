"""Exact top-k by inner product: bounds from means and deviations of segments, coarse to fine, then exact scores.

Cut two vectors into the same segments of m components, with means a, b and deviations s, t. Then m * (a * b + s * t),
added over the segments, is at least their inner product (which is the same as a lower bound of their distance), and finer
segments bound it more closely. A candidate whose bound is under a query's k-th best score so far needs no further look."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import meet, ship, stash

SCALE = 64
EVERY = 20
TOP = 20
#: Segments of the levels.
LEVELS = (4, 16, 32)
#: Rows in a block of candidates and in a block of queries, at most; a joined pair of blocks is a few MB.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Bytes of numbers that a block holds at most, for vectors of very many components.
BLOCK_BYTES = 4 << 20
#: Groups of candidate blocks at most, or as many as a shuffle has partitions, if these are more. Each gets a copy of all queries.
GROUPS = 256
#: Query blocks whose best rows a task keeps before it hands them on.
KEPT_BLOCKS = 64
#: Doubles hold integers exactly up to here.
EXACT = 2.0**53
_KINDS = (np.int8, np.int16, np.int32)


def pack(matrix: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest kind that holds them."""
    most = np.abs(matrix).max(initial=0)
    kind = next((k for k in _KINDS if most <= np.iinfo(k).max), np.float64)
    return np.dtype(kind).str, np.ascontiguousarray(matrix.astype(kind)).tobytes()


def unpack(kind: str, width: int, data: bytes) -> np.ndarray:
    got = np.frombuffer(data, kind).astype(np.float64)
    return got.reshape(-1, width) if width else got.reshape(0, 0)


BLOCK = "block long, ids binary, n int, width int, kind string, numbers binary"


def _pack_blocks(scale: int, rows: int):
    """Rows (vec_id, embedding) as blocks, in the order in which they come; vectors that are shorter than others of their block get zeros."""

    def block(number: int, ids: list[np.ndarray], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.concatenate([s for s, _ in parts])
        width = int(sizes.max(initial=0))
        matrix = np.zeros((len(sizes), width))
        matrix[np.arange(width) < sizes[:, None]] = np.floor(scale * np.concatenate([v for _, v in parts]))
        if not np.isfinite(matrix).all():
            raise ValueError("a component is too large to be scaled")
        kind, data = pack(matrix)
        values = [number, np.concatenate(ids).astype(np.int64).tobytes(), len(sizes), width, kind, data]
        names, types = ["block", "ids", "n", "width", "kind", "numbers"], [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            step = max(1, min(rows, BLOCK_BYTES // (8 * max(1, int(sizes.max(initial=1))))))
            at = 0
            while at < len(batch):
                take = max(1, min(step - held, len(batch) - at))
                ids.append(all_ids[at : at + take])
                parts.append((sizes[at : at + take], column.slice(at, take).flatten().to_numpy(zero_copy_only=False).astype(np.float64)))
                held, at = held + take, at + take
                if held >= step:
                    yield block(number, ids, parts)
                    number, ids, parts, held = number + 1, [], [], 0
        if held:
            yield block(number, ids, parts)

    return run


def sketch(matrix: np.ndarray, segments: int) -> np.ndarray:
    """For each row the means and deviations of its segments, times the root of their length: the product of two rows' sketches
    bounds the product of the rows."""
    width = matrix.shape[1]
    edges = np.unique(np.linspace(0, width, min(segments, width) + 1).astype(int))
    if width == 0:
        return np.zeros((len(matrix), 0))
    m = np.diff(edges)
    mean = np.add.reduceat(matrix, edges[:-1], axis=1) / m
    square = np.add.reduceat(matrix * matrix, edges[:-1], axis=1) / m
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]) * np.sqrt(np.tile(m, 2))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a with those of b, one by one, as whole numbers."""
    if a.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        return np.array([sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)], object).astype(np.int64)
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


class Best:
    """The k best (score, least id) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.q, self.score, self.vec = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)  # the k-th best score

    def add(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        q, vec, score = (np.concatenate(x) for x in ((self.q, q), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.q, self.vec, self.score = q[top], vec[top], score[top]
        full = place == self.k - 1
        self.least[q[full]] = score[full]


def search_block(best: Best, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, levels: tuple[int, ...] = LEVELS) -> int:
    """Add to best what a block of candidates (ids, rows) has for queries; gives the number of exact scores worked out."""
    width = max(queries.shape[1], rows.shape[1])
    wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    queries, rows = wide(queries), wide(rows)
    open_ = best.ids[:, None] != ids[None, :]
    for segments in levels:
        if segments >= width:
            break
        use = np.flatnonzero(open_.any(axis=0))
        if not len(use) or np.isneginf(best.least).all():
            break
        bound = sketch(queries, segments) @ sketch(rows[use], segments).T
        open_[:, use] &= bound * (1 + 1e-9) + 1e-6 >= best.least[:, None]
    done = 0
    q, c = np.nonzero(open_)
    safe = width * np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) < EXACT
    together = queries @ rows.T if safe and len(q) > 0.1 * open_.size else None  # many are left: all at once is less work
    for at in range(0, len(q), 1 << 16):
        a, b = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
        score = exact_products(queries[a], rows[b]) if together is None else together[a, b].astype(np.int64)
        good = score >= best.least[a]
        best.add(a[good], ids[b[good]], score[good])
        done += len(a)
    return done


def _search(k: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Best] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for number, b in kept.items():
                columns = [np.full(len(b.q), number), b.q, b.ids[b.q], b.vec, b.score]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["block", "place", "query_id", "vec_id", "score"])
            kept.clear()

        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                if row["q_block"] not in kept and len(kept) >= KEPT_BLOCKS:
                    yield from out()
                best = kept.setdefault(row["q_block"], Best(q_ids, k))
                queries = unpack(row["q_kind"], row["q_width"], row["q_numbers"]) if row["q_width"] else np.zeros((len(q_ids), 0))
                rows = unpack(row["kind"], row["width"], row["numbers"]) if row["width"] else np.zeros((len(ids), 0))
                search_block(best, queries, ids, rows, levels)
        yield from out()

    return run


def top_products(vectors: DataFrame, is_query: Column | None = None, k: int = TOP, scale: int = SCALE, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """For each query its k best rows of vectors (all, if fewer): query_id, rank, vec_id, score.

    Reads vec_id and embedding; other columns don't matter. Each component x becomes floor(scale * x); the score is the inner
    product of these whole numbers, in 64 bits; ties go to the smaller vec_id. is_query: by default, vec_id is divisible by EVERY.
    A query's own row is no candidate of it, nor is any row of its vec_id. Rows without an id or a vector, or with a
    component that is null or not finite, take no part. A shorter vector counts as if zeros followed, an empty one scores 0 with all.
    Repeated rows are candidates each, and as queries asked once; rows that share an id but not the vector are queries of
    their own, each with ranks from 1. An empty table gives no rows.

    Candidates are packed into blocks where they lie, queries into blocks by a hash, and each pair of blocks is
    one joined row, so that no task needs all queries; a task carries a query block's best rows from one candidate block to the next.
    Both sides shuffle: by the size of the files of queries, Spark would send their copies through the driver. The queries
    stream, and only the candidate blocks of one group are held."""
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = numbers.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    blocks = stash(usable.mapInArrow(_pack_blocks(scale, BLOCK_ROWS), BLOCK), "vector-blocks")
    asked = stash(usable.filter(F.col("vec_id") % EVERY == 0 if is_query is None else is_query).distinct(), "vector-queries")
    n = asked.count()
    spread = asked.repartition(max(1, -(-n // QUERY_ROWS)), F.xxhash64("vec_id", "embedding"))
    queries = stash(spread.mapInArrow(_pack_blocks(scale, QUERY_ROWS), BLOCK), "query-blocks")
    groups = max(1, min(blocks.count(), max(GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    candidates = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    copies = queries.select(*[F.col(c).alias("q_" + c) for c in queries.columns if c != "n"], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    found = meet(copies, candidates, "g").select("ids", "width", "kind", "numbers", "q_block", "q_ids", "q_width", "q_kind", "q_numbers").mapInArrow(_search(k, levels), "block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
