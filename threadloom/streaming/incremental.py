"""Resumable ingest of files that arrive or grow: a file-source stream into hash-partitioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.index import upsert

FILES = "path string, hash string, conversations long, error string"
#: Parts of a table by hash of its keys; a batch writes those that it changes.
PARTS = 64
#: Versions in use after which a batch writes all parts, so that earlier ones need not be listed any more.
MAX_VERSIONS = 32


def read_table(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A table under path/v=<n>/part=<p>: of each part the newest whole version, of those below `before` if given."""
    newest = _newest(spark, path, before)
    folders = [f"{path}/v={v}/part={p}" for p, v in sorted(newest.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The newest whole version of each part, walking back from the newest one to one that holds all parts."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    number = lambda status: int(status.getPath().getName().split("=")[1])
    versions = {number(s): s.getPath() for s in fs.listStatus(where)}
    newest: dict[int, int] = {}
    for v in sorted(versions, reverse=True):
        if (before is not None and v >= before) or not fs.exists(jvm.org.apache.hadoop.fs.Path(versions[v], "_SUCCESS")):
            continue
        for s in fs.listStatus(versions[v]):
            if s.getPath().getName().startswith("part="):
                newest.setdefault(number(s), v)
        if len(newest) == PARTS:
            break
    return newest


def write_changes(spark: SparkSession, path: str, schema: str, incoming: DataFrame, keys: list[str], batch: int) -> None:
    """Upsert incoming by keys into the table's version before this batch, writing changed parts only.

    A replayed batch rewrites its own version from the same base, so the write is idempotent; a version counts once
    it is whole. incoming should be cheap to read twice."""
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    live = _newest(spark, path, batch)
    incoming = incoming.withColumn("part", part)
    changed = {r["part"] for r in incoming.select("part").distinct().collect()}  # at most PARTS rows
    if len(set(live.values())) >= MAX_VERSIONS:
        changed |= set(live)
    folders = [f"{path}/v={live[p]}/part={p}" for p in sorted(changed) if p in live]
    base = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    merged = upsert(base.withColumn("part", part), incoming.select(*base.columns, "part"), keys)
    merged.repartition(PARTS, "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v={batch}")


def incremental_ingest(
    spark: SparkSession,
    source: str,
    target: str,
    parse: Callable[[DataFrame], DataFrame],
    schema: str,
    keys: list[str],
    glob: str = "*.jsonl",
) -> StreamingQuery:
    """Follow source with a file stream; parse (path, value) of new files to rows of schema; upsert them by keys.

    parse also gets to say what failed: rows with a null first key become the file's error and the file is not
    recorded as done, so that a later copy of it is read again. Files whose content hash was recorded are skipped;
    of files of equal content in a batch the first by path is parsed, and all are recorded. Of rows of one key in a
    batch the one from the last file by path stays.
    Tables: target/rows and target/files, the latter (path, hash, conversations, error)."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source)
    stream = stream.select(F.col("_metadata.file_path").alias("path"), "value", F.sha2("value", 256).alias("hash"))

    def one(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        known = read_table(s, f"{target}/files", FILES, batch_id).filter("error is null").select("hash")
        new = batch.join(known, "hash", "left_anti").persist()
        first = new.groupBy("hash").agg(F.min("path").alias("path"))
        parsed = parse(new.join(first, ["hash", "path"], "left_semi").select("path", "value")).persist()
        bad = F.col(keys[0]).isNull()
        counts = parsed.groupBy("path").agg(F.count(F.when(~bad, 1)).alias("conversations"), F.when(F.max(bad.cast("int")) == 1, F.lit("unreadable")).alias("error"))
        by_hash = first.join(counts, "path", "left").select("hash", F.coalesce("conversations", F.lit(0)).cast("long").alias("conversations"), "error")
        rest = [c for c in parsed.columns if c not in keys and c != "path"]
        good = parsed.filter(~bad).groupBy(*keys).agg(F.max_by(F.struct("path", *rest), "path").alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])
        # rows first: a file counts as done only after its rows are there
        write_changes(s, f"{target}/rows", schema, good, keys, batch_id)
        write_changes(s, f"{target}/files", FILES, new.select("path", "hash").join(by_hash, "hash"), ["path"], batch_id)
        parsed.unpersist()
        new.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{target}/_checkpoint").trigger(availableNow=True).start()
