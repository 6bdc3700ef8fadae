"""Files of JSON lines: walking, quarantining bad lines, preferring plain over compressed files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.sources.lines import file_path, numbered_lines, walk


def prefer_plain(files: DataFrame, path: str = "path") -> DataFrame:
    """Of x and x.zst, which are one session, the plain file."""
    stem = F.regexp_replace(F.col(path), r"\.zst$", "")
    first = F.row_number().over(Window.partitionBy(stem).orderBy(F.col(path).endswith(".zst").cast("int"), path))
    return files.withColumn("_n", first).filter("_n = 1").drop("_n")


def read_json_lines(spark: SparkSession, paths: str | Iterable[str], glob: str = "*.jsonl*") -> tuple[DataFrame, DataFrame]:
    """(records (path, line, json), errors (path, line, reason)).

    Walks folders; a blank line is skipped, one that is not a JSON object becomes an error with its 1-based
    number. Nothing aborts the read, and no file is too large: plain files are read by as many tasks as they have blocks,
    compressed ones by one each."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    chosen = prefer_plain(walk(spark, "binaryFile", glob).load(paths).select(file_path().alias("path"), F.col("length").alias("bytes")))
    text = numbered_lines(spark, paths, glob, files=chosen)
    lines = text.select("path", "line", F.regexp_replace("value", "\r$", "").alias("json")).filter(F.trim("json") != "")
    judged = lines.withColumn("kind", F.schema_of_variant(F.try_parse_json("json")))
    ok = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("kind").isNull(), "invalid JSON").otherwise("not an object")
    unread = chosen.filter("bytes > 0").join(text.filter("line = 1").select("path"), "path", "left_anti")
    bad_files = unread.select("path", F.lit(0).cast("long").alias("line"), F.lit("unreadable file").alias("reason"))
    return judged.filter(ok).drop("kind"), judged.filter(~ok).select("path", "line", reason.alias("reason")).unionByName(bad_files)


def at(path: str, json: str = "json") -> Column:
    """A field of the JSON text as a string, '' where there is none."""
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(""))


def island(starts: Column, *by: str, order: str = "line") -> Column:
    """Running number of the runs that begin where starts is true."""
    return F.sum(starts.cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
