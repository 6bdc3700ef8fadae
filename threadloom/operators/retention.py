"""Retention plans over file targets, and the ledger of runs. Plans only: nothing is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import basename
from threadloom.operators.index import upsert

#: Fixed value: path parts of stores that must not be touched.
PROTECTED = ("\\.codex\\sessions\\", "\\.codex\\state_5.sqlite", "\\.codex\\codex-sqlite\\")


def _slashed(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(path, F.lit("/"), F.lit("\\"))), r"\\(\.?\\)+", "\\\\")


def spells_protected(path: Column) -> Column:
    p = F.concat(F.rtrim(_slashed(path), F.lit("\\")), F.lit("\\"))
    hit = F.lit(False)
    for mark in PROTECTED:
        hit = hit | p.contains(mark)
    return hit


def effective_root(action: str, destination_root: str, checkpoint_root: str) -> str:
    """Where allowed files would go: a delete is a quarantine under the checkpoint root."""
    return {"delete": f"{checkpoint_root}/deleted", "reconcile": f"{destination_root}/reconciled"}.get(action, destination_root)


def retention_plan(targets: DataFrame, action: str, store_root: str, destination_root: str = "", checkpoint_root: str = "/checkpoints", occupied: DataFrame | None = None) -> DataFrame:
    """targets (position, session_id, file_path, store_kind, size_bytes, is_hot) with reason, destination, warning.

    reason (null: allowed), in this order: unsafe-path (blank, NUL or not absolute), traversal (a '..' part),
    outside-store-root, protected (live, or a protected path), duplicate-target (planned by an earlier row).
    Destinations are unique: of equal names, without case, the later take -1, -2, ...; a suffixed name that is
    itself somebody's plain name counts on from there. occupied: (name) of files already there. Raises ValueError if the
    destination is itself protected or missing."""
    if action != "delete" and not destination_root.strip():
        raise ValueError(f"a destination root is required for {action}")
    root = effective_root(action, destination_root, checkpoint_root)
    if any(m in (root.replace("/", "\\").lower().rstrip("\\") + "\\") for m in PROTECTED):
        raise ValueError("the destination is a protected store path")
    path = F.col("file_path")
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.lower(plain).startswith(store_root.replace("\\", "/").rstrip("/").lower() + "/")
    absolute = plain.startswith("/") | plain.rlike("^[A-Za-z]:/")
    base = (
        F.when((F.trim(path) == "") | path.contains("\x00") | ~absolute, "unsafe-path")
        .when(F.array_contains(F.split(plain, "/"), ".."), "traversal")
        .when(~inside, "outside-store-root")
        .when((F.col("store_kind") == "live") | spells_protected(path), "protected")
    )
    ok = targets.withColumn("reason", base)
    again = F.row_number().over(Window.partitionBy(F.lower("file_path"), F.col("reason").isNull()).orderBy("position")) > 1
    ok = ok.withColumn("reason", F.when(F.col("reason").isNull() & again, "duplicate-target").otherwise(F.col("reason")))
    name = basename(path)
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    named = ok.withColumn("stem", F.when(F.col("reason").isNull(), stem)).withColumn("ext", F.when(F.col("reason").isNull(), ext))
    taken = F.lit(0)
    if occupied is not None:
        there = occupied.select(F.lower("name").alias("lname")).distinct().withColumn("there", F.lit(1))
        named = named.withColumn("lname", F.lower(F.concat("stem", "ext"))).join(there, "lname", "left").drop("lname")
        taken = F.coalesce("there", F.lit(0))
    nth = F.row_number().over(Window.partitionBy(F.lower(F.concat("stem", "ext")), F.col("reason").isNull()).orderBy("position")) - 1 + taken
    named = named.withColumn("nth", nth)
    # second pass: a suffixed name that equals a plain name of the batch moves past all its namesakes
    plain_names = named.filter("reason is null and nth = 0").select(F.lower(F.concat("stem", "ext")).alias("plain")).distinct()
    cand = F.lower(F.concat("stem", F.lit("-"), "nth", "ext"))
    named = named.withColumn("cand", F.when(F.col("nth") > 0, cand)).join(plain_names, F.col("cand") == F.col("plain"), "left")
    size = F.count(F.when(F.col("reason").isNull(), 1)).over(Window.partitionBy(F.lower(F.concat("stem", "ext"))))
    final = F.when(F.col("plain").isNotNull(), F.col("nth") + size).otherwise(F.col("nth"))
    dest = F.concat(F.lit(root + "/"), F.col("stem"), F.when(final > 0, F.concat(F.lit("-"), final)).otherwise(""), F.col("ext"))
    warning = (
        F.when(F.col("reason") == "duplicate-target", "review: duplicate target ignored")
        .when(F.col("reason").isNotNull(), "dangerous: blocked")
        .when(F.col("is_hot"), "review: target is being written")
        .otherwise("dangerous: maintenance target")
    )
    return named.select("position", "session_id", "file_path", "store_kind", "size_bytes", "reason", F.when(F.col("reason").isNull(), dest).alias("destination"), warning.alias("warning"))


def plan_summary(plan: DataFrame, action: str) -> DataFrame:
    """One row: allowed, blocked and the phrase to confirm with."""
    n = plan.agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("allowed"), F.count("reason").alias("blocked"))
    files = F.when(F.col("allowed") == 1, " FILE").otherwise(" FILES")
    return n.select("allowed", "blocked", F.concat(F.lit(action.upper() + " "), "allowed", files).alias("confirmation"))


def record_run(ledger: DataFrame, run: DataFrame) -> DataFrame:
    """ledger (manifest, at_ms, ...) with run in place of the row of its manifest."""
    return upsert(ledger, run, ["manifest"])


def recent_runs(ledger: DataFrame, limit: int = 20) -> DataFrame:
    return ledger.orderBy(F.col("at_ms").desc(), "manifest").limit(limit)
