"""Session set-up and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, MapType, NumericType, StringType, StructType, TimestampType

#: Rows, and bytes of their values, up to which a side may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Rows of one key beyond which join_split() spreads them over several tasks.
HOT_ROWS = 4096


def local_session(cpus: int = 8, app: str = "threadloom", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where it is unset on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stashed_at = path
    return kept


def discard(*stashed: DataFrame) -> None:
    """Delete tables made by stash() that nothing will read again."""
    for df in stashed:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many more underscores as it takes to differ from all columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def width(df: DataFrame) -> Column:
    """Bytes of a row's values, about."""
    fixed = sum(8 for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType)))
    texts = [F.coalesce(F.octet_length(named(f.name)), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    other = [named(f.name) for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    nested = [F.octet_length(F.to_json(F.struct(*other)))] if other else []
    total = F.lit(fixed)
    for part in texts + nested:
        total = total + part
    return total.cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and about so many bytes; looks no further than that many rows."""
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width(df)), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= rows and seen["bytes"] <= size


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts the right side only after counting its rows and bytes; beyond the limits it shuffles."""
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the data: both are shuffled. The files of a stashed table are far smaller than its rows,
    so that by their size Spark would send millions of rows through the driver to every executor."""
    return left.join(right.hint("merge"), on, how)


def hot_keys(left: DataFrame, on: list[str], each: int | None = None) -> DataFrame:
    """(on..., blocks): the keys that more than so many rows (HOT_ROWS) have, and how many blocks of so many rows these fill.

    At most one row for that many rows of left; counted with a map-side combine."""
    each = each or HOT_ROWS
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n__")).filter(F.col("n__") > each)
    return sizes.select(*on, F.ceil(F.col("n__") / each).cast("int").alias("blocks__"))


def join_split(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left.join(right, on, how) in which no task gets all rows of a hot key.

    The left rows of a hot key go to as many blocks as they fill, by a hash of the columns spread (which should tell them
    apart), and right's rows of that key are repeated in each block: for a key of r left rows that is r / HOT_ROWS times.
    how: inner, left, left_semi or left_anti, where a left row has to meet all right rows of its key and no other left row.
    hot: hot_keys() of left where the caller has it already; left is counted first if not. Null keys match nothing."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join_split can't do a {how} join")
    hot = stash(hot_keys(left, on), "hot") if hot is None else hot
    if hot.limit(1).count() == 0:
        return left.join(right, on, how)
    block = fresh(left.join(right.limit(0), on, "left"), "block__") if how in ("inner", "left") else fresh(left, "block__")
    blocks = F.coalesce("blocks__", F.lit(1))
    cut = join_checked(left, hot, on, "left").withColumn(block, F.pmod(F.xxhash64(*spread), blocks).cast("int")).drop("blocks__")
    copies = join_checked(right, hot, on, "left").withColumn(block, F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks__")
    return cut.join(copies, [*on, block], how).drop(block)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """left.k <=> right.k for all keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_threadloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="threadloom-ship-")) / "threadloom_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("threadloom") / f.relative_to(root))
    sc.addPyFile(str(target))
    sc._threadloom_shipped = True
