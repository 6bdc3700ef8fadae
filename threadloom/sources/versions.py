"""A folder whose contents change as a whole: writers announce a value, readers take the newest that is complete."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _complete(spark: SparkSession, root: str) -> list[str]:
    fs, at = folder(spark, f"{root}/manifests")
    if not fs.exists(at):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(p for p in found if fs.exists(folder(spark, f"{p}/_SUCCESS")[1]))


def newest(spark: SparkSession, root: str) -> str | None:
    """What was announced last; null where nothing was."""
    whole = _complete(spark, root)
    return spark.read.schema("value string").json(whole[-1]).first()["value"] if whole else None


def announce(spark: SparkSession, root: str, value: str) -> None:
    """From now on readers get value. Its manifest counts once Spark has marked it complete; a second writer with the same number fails."""
    whole = _complete(spark, root)
    number = int(whole[-1].rstrip("/").rsplit("/", 1)[1]) + 1 if whole else 0
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.json(f"{root}/manifests/{number:09d}")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = folder(spark, path)
    fs.delete(at, True)
