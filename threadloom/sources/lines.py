"""Lines and elements of large text files, numbered by many tasks, and figures that are carried along them.

Spark cuts a file into blocks. Lines are counted per block, the counts are summed over the blocks of a file, and so every task
knows the numbers of its own lines. In the same way a running figure of a file is worked out within stretches of lines, and what
the stretches come to is carried over them: no task holds a whole file, and no window more than a stretch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import decoded_dir
from threadloom.session import join_checked, stash

#: Lines of a stretch.
STRETCH = 1 << 16


def file_path() -> Column:
    """The path of the file a row comes from, as it is on disk: Spark gives it as an encoded URI."""
    return decoded_dir(F.col("_metadata.file_path"))


def walk(spark: SparkSession, kind: str, glob: str):
    return spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)


def numbered_lines(spark: SparkSession, paths: str | Iterable[str], glob: str, separator: str = "\n", files: DataFrame | None = None) -> DataFrame:
    """(path, line, value): the parts between separators of all files, or of those in files (path), numbered from 1 in each.

    The count reads the files once more, but moves a row a block. Blank parts count. What can't be read gives no rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = walk(spark, "text", glob).option("lineSep", separator).option("ignoreCorruptFiles", "true").load(paths)
    # ids rise along the rows of a task, so those of a block are consecutive
    raw = raw.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = raw.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    if files is not None:
        blocks = blocks.join(files.select("path"), "path", "left_semi")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stash(blocks.withColumn("before", before), "line-blocks")
    at = F.col("before") + F.col("id") - F.col("first")
    checked = F.when((at < F.col("before")) | (at >= F.col("before") + F.col("n")), F.raise_error(F.lit("the files were split anew between two passes"))).otherwise(at + 1)
    return join_checked(raw, blocks, ["path", "block"]).select("path", checked.cast("long").alias("line"), "value")


def carried(rows: DataFrame, name: str, how: str, value: Column, by: str, order: str = "line", before: bool = False) -> DataFrame:
    """rows with a running figure of value by by along order, this row included, or up to the row before; null where there is none.

    how: 'sum', 'max' or 'last' (the last that is not null). order: whole numbers, distinct in by. rows is read twice."""
    stretch = name + "__stretch"
    keyed = rows.withColumn(stretch, F.floor(F.col(order) / STRETCH))
    if how == "last":
        over, total = (lambda c: F.last(c, ignorenulls=True)), F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        join = lambda near, far: F.coalesce(near, far)
    elif how == "max":
        over, total = F.max, F.max(value)
        join = lambda near, far: F.greatest(near, far)
    else:
        over, total = F.sum, F.sum(value)
        join = lambda near, far: F.when(near.isNull() & far.isNull(), F.lit(None)).otherwise(F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
    far = name + "__far"
    totals = keyed.groupBy(by, stretch).agg(total.alias(far))
    totals = totals.withColumn(far, over(F.col(far)).over(Window.partitionBy(by).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)))
    near = over(value).over(Window.partitionBy(by, stretch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    out = join_checked(keyed.withColumn(name, near), totals, [by, stretch], "left")
    return out.withColumn(name, join(F.col(name), F.col(far))).select(*[c for c in rows.columns if c != name], name)


def number_turns(rows: DataFrame, by: str, order: str = "line") -> DataFrame:
    """(by, order, turn_idx, block_at) from rows (by, order, user, parts): each user row is a turn of its own, what lies between
    two of them another. block_at: the parts of the turn's earlier rows."""
    light = stash(rows.select(by, order, "user", "parts"), "turn-rows")
    opened = carried(light, "prior", "last", F.col("user"), by, order, before=True)
    opened = stash(opened.withColumn("opens", F.col("user") | F.coalesce("prior", F.lit(True))), "turn-rows")
    counted = carried(carried(opened, "turns", "sum", F.col("opens").cast("long"), by, order), "had", "sum", F.col("parts").cast("long"), by, order, before=True)
    counted = stash(counted.withColumn("had", F.coalesce("had", F.lit(0))), "turn-rows")
    placed = carried(counted, "start", "max", F.when(F.col("opens"), F.col("had")), by, order)
    return placed.select(by, order, (F.col("turns") - 1).cast("int").alias("turn_idx"), (F.col("had") - F.col("start")).cast("int").alias("block_at"))


def number_runs(rows: DataFrame, value: str, by: str, order: str = "line") -> DataFrame:
    """(by, order, run): which run of equal values a row belongs to."""
    light = stash(rows.select(by, order, value), "run-rows")
    changed = carried(light, "prior", "last", F.col(value), by, order, before=True)
    changed = stash(changed.select(by, order, F.coalesce(F.col(value) != F.col("prior"), F.lit(True)).cast("long").alias("new")), "run-rows")
    return carried(changed, "run", "sum", F.col("new"), by, order).drop("new")


def array_elements(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, pos, json): the elements of JSON array files, from 0; a file that holds an object is one element.

    Files are cut at closing braces. A piece tells by itself how many quotes it holds, and how far it goes up or down in nesting
    if it begins inside or outside a string. Sums of these along a file tell where each piece begins, and so which closing
    braces end an element. Only an element is put together again, so memory is that of the largest one; elements that
    aren't JSON are left out."""
    pieces = numbered_lines(spark, path, glob, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    within = F.regexp_replace(plain, r'(?s)^[^"]*("|$)', "")
    count = lambda text, marks: F.length(text) - F.length(F.translate(text, marks, ""))
    bare = lambda text: F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")
    steps = lambda text: count(bare(text), "{[") - count(bare(text), "]")
    light = pieces.select("path", "line", count(plain, '"').alias("quotes"), steps(plain).alias("from_outside"), steps(within).alias("from_inside"), F.substring(F.regexp_replace("value", r"^[\s\uFEFF]+", ""), 1, 1).alias("first"))
    light = stash(light, "pieces")
    stated = carried(light, "seen", "sum", F.col("quotes"), "path", before=True)
    inside = F.coalesce(F.col("seen"), F.lit(0)) % 2 == 1
    ends_outside = (F.coalesce(F.col("seen"), F.lit(0)) + F.col("quotes")) % 2 == 0
    last = F.max("line")
    heads = light.groupBy("path").agg(last.alias("last"), F.max(F.when(F.col("line") == 1, F.col("first") == "[")).alias("is_array"))
    stated = join_checked(stated.select("path", "line", F.when(inside, F.col("from_inside")).otherwise(F.col("from_outside")).alias("up"), ends_outside.alias("closes")), heads, "path")
    # the last piece is what follows the last brace
    stated = stash(stated.withColumn("closes", F.col("closes") & (F.col("line") < F.col("last"))), "pieces")
    deep = stash(carried(stated, "depth", "sum", F.col("up") - F.col("closes").cast("int"), "path"), "pieces")
    ended = deep.withColumn("ends", F.col("closes") & (F.col("depth") == 1) & F.col("is_array"))
    grouped = carried(ended, "part", "sum", F.col("ends").cast("long"), "path", before=True).select("path", "line", F.coalesce("part", F.lit(0)).alias("part"), "ends", "is_array", "depth")
    texts = pieces.join(grouped, ["path", "line"]).groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("p"), F.max("ends").alias("ends"), F.max("is_array").alias("is_array"), F.max_by("depth", "line").alias("depth"))
    joined = F.array_join(F.transform("p", lambda x: x.value), "}")
    whole = F.regexp_replace(F.concat(joined, F.when(F.col("depth") == 1, "}").otherwise("")), r"^\uFEFF", "")
    # what lies between two cuts is a list of its own: a comma or the opening bracket before it, the closing one after the last
    part = F.concat(F.lit("["), F.regexp_replace(joined, r"^[\s\uFEFF]*[\[,]?", ""), F.when(F.col("ends"), "}]").when(joined.rlike(r"\]\s*$"), "").otherwise("]"))
    elements = F.when(F.col("is_array"), F.try_variant_get(F.try_parse_json(part), "$", "array<variant>")).otherwise(F.array(F.try_parse_json(whole)))
    listed = stash(texts.select("path", "part", F.transform(elements, lambda v: F.to_json(v)).alias("e")).withColumn("n", F.coalesce(F.size("e"), F.lit(0)).cast("long")).filter("n > 0"), "elements")
    placed = carried(listed.select("path", "part", "n"), "at", "sum", F.col("n"), "path", "part", before=True)
    each = listed.join(placed.select("path", "part", "at"), ["path", "part"]).select("path", F.coalesce("at", F.lit(0)).alias("at"), F.posexplode("e").alias("i", "json"))
    return each.select("path", (F.col("at") + F.col("i")).alias("pos"), "json").filter("json is not null")
