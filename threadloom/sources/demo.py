"""Canonical tables derived by fixed rules from the driver's synthetic tables, and the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalars import first_line


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, title, provider, account, thread_id, created_at, updated_at, conv_id)."""
    raw = read(spark, sf_dir, "conversations")
    heads = raw.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("t"))
    n = F.col("conv_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd'T00:00:00Z'")
    return heads.select(
        F.concat(F.lit("c"), n).alias("conversation_id"),
        F.coalesce(first_line(F.col("t")), F.lit("")).alias("title"),
        F.element_at(F.array(*map(F.lit, ("chatgpt", "claude", "codex"))), (n % 3 + 1).cast("int")).alias("provider"),
        F.concat(F.lit("a"), n % 5).alias("account"),
        F.concat(F.lit("t"), n + 1).alias("thread_id"),
        F.when(n % 11 == 0, "").otherwise(day).alias("created_at"),
        F.when(n % 11 == 0, "").otherwise(day).alias("updated_at"),
        "conv_id",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, turn_idx, role, block_idx, type, text)."""
    raw = read(spark, sf_dir, "conversations")
    return raw.select(
        F.concat(F.lit("c"), "conv_id").alias("conversation_id"),
        F.col("turn").alias("turn_idx"),
        F.when(F.col("role") == "user", "human").otherwise("assistant").alias("role"),
        F.lit(0).alias("block_idx"),
        F.lit("text").alias("type"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


#: CTEs that repeat the two rules above and the index built from them.
CONV_SQL = """
bl AS (SELECT 'c' || conv_id AS conversation_id, turn AS turn_idx, CASE WHEN role = 'user' THEN 'human' ELSE 'assistant' END AS role, coalesce(text, '') AS text FROM conversations),
cv AS (SELECT 'c' || conv_id AS conversation_id, conv_id,
  coalesce(substr(string_split(ltrim(coalesce(arg_min(text, turn) FILTER (role = 'user'), '')), chr(10))[1], 1, 80), '') AS title,
  CASE conv_id % 3 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' ELSE 'codex' END AS provider,
  'a' || (conv_id % 5) AS account, 't' || (conv_id + 1) AS thread_id,
  CASE WHEN conv_id % 11 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(conv_id AS INTEGER), '%Y-%m-%dT00:00:00Z') END AS created_at
  FROM conversations GROUP BY conv_id),
ix AS (SELECT cv.conversation_id, any_value(title) AS title, any_value(provider) AS provider, any_value(account) AS account, any_value(thread_id) AS thread_id, any_value(created_at) AS created_at,
  CAST(count(DISTINCT turn_idx) AS BIGINT) AS turn_count, any_value(title) || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY turn_idx) FILTER (text <> ''), '') AS body
  FROM cv JOIN bl USING (conversation_id) GROUP BY 1)"""


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("t"), k).alias("id"),
        F.col("c_name").alias("title"),
        F.element_at(F.array(*map(F.lit, ("openai", "anthropic", "xai"))), (k % 3 + 1).cast("int")).alias("model_provider"),
        (k % 97).cast("long").alias("tokens_used"),
        F.when(k % 13 != 0, 1704067200000 + k * 60000).cast("long").alias("created_at_ms"),
        F.when(k % 13 != 0, 1704067200000 + k * 90000).cast("long").alias("updated_at_ms"),
        F.concat(F.lit("main"), k % 4).alias("git_branch"),
        F.concat(F.lit("/home/ana/p"), k % 7).alias("cwd"),
        F.lit("worker").alias("agent_role"),
        F.concat(F.lit("n"), k).alias("agent_nickname"),
        F.col("c_mktsegment").alias("preview"),
        F.concat(F.lit("/home/ana/logs/r"), k, F.lit(".jsonl")).alias("rollout_path"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree (parent = key / 3), diamonds where key % 50 = 0, and a few parents beyond the largest key."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey")
    up = F.floor(k / 3).cast("long")
    name = lambda x: F.concat(F.lit("t"), x)
    tree = c.filter(k > 1).select(name(F.greatest(up, F.lit(1))).alias("parent"), name(k).alias("child"), F.lit("done").alias("status"))
    diamond = c.filter((k % 50 == 0) & (up + 1 < k)).select(name(up + 1).alias("parent"), name(k).alias("child"), F.lit("open").alias("status"))
    dangling = c.filter(k % 400 == 0).select(name(k + 1_000_000).alias("parent"), name(k).alias("child"), F.lit("lost").alias("status"))
    return tree.unionByName(diamond).unionByName(dangling)


GRAPH_SQL = """
th AS (SELECT 't' || c_custkey AS id, c_name AS title, CASE c_custkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'xai' END AS model_provider, CAST(c_custkey % 97 AS BIGINT) AS tokens_used,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(1704067200000 + c_custkey * 60000 AS BIGINT) END AS created_at_ms, c_custkey FROM customer),
ed AS (SELECT 't' || greatest(c_custkey // 3, 1) AS parent, 't' || c_custkey AS child, 'done' AS status FROM customer WHERE c_custkey > 1
  UNION ALL SELECT 't' || (c_custkey // 3 + 1), 't' || c_custkey, 'open' FROM customer WHERE c_custkey % 50 = 0 AND c_custkey // 3 + 1 < c_custkey
  UNION ALL SELECT 't' || (c_custkey + 1000000), 't' || c_custkey, 'lost' FROM customer WHERE c_custkey % 400 = 0),
nd AS (SELECT id FROM th UNION SELECT parent FROM ed UNION SELECT child FROM ed)"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, file_path, store_kind, last_write_ms, size_bytes)."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.when(i % 40 == 0, F.lit(" ")).otherwise(F.md5(F.lower("text"))).alias("session_id"),
        F.concat_ws("/", "source", i).alias("file_path"),
        F.element_at(F.array(*map(F.lit, ("live", "backup", "mirror"))), (i % 3 + 1).cast("int")).alias("store_kind"),
        F.when(i % 7 != 0, i * 1000).cast("long").alias("last_write_ms"),
        F.col("n_chars").cast("long").alias("size_bytes"),
    )


COPY_SQL = """
cp AS (SELECT CASE WHEN doc_id % 40 = 0 THEN ' ' ELSE md5(lower(text)) END AS session_id, source || '/' || doc_id AS file_path,
  CASE doc_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'backup' ELSE 'mirror' END AS store_kind,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id * 1000 AS BIGINT) END AS last_write_ms, CAST(n_chars AS BIGINT) AS size_bytes FROM documents)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, alias, tags, notes) from labels, one for each labelled document number."""
    n = F.col("doc_id")
    return read(spark, sf_dir, "labels").select(
        F.concat(F.lit("c"), n).alias("conversation_id"),
        F.concat(F.lit("alias "), n).alias("alias"),
        F.filter(F.array(F.when(F.col("quality") == 1, "Good").otherwise("poor"), F.when(F.col("toxic") == 1, "TOXIC"), F.when(n % 2 == 0, "good")), lambda t: t.isNotNull()).alias("tags"),
        F.when(n % 4 == 0, "to check").otherwise("").alias("notes"),
    )


NOTE_SQL = """
an AS (SELECT 'c' || doc_id AS conversation_id, 'alias ' || doc_id AS alias,
  list_filter([CASE WHEN quality = 1 THEN 'Good' ELSE 'poor' END, CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN doc_id % 2 = 0 THEN 'good' END], lambda t: t IS NOT NULL) AS tags,
  CASE WHEN doc_id % 4 = 0 THEN 'to check' ELSE '' END AS notes FROM labels)"""
