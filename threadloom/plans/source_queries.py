"""Registered queries of the adapters: records and files made from the driver's tables, and what must come out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.plans.queries import FOLDED, _exported, _folded, _talk, _written, query
from threadloom.sources import demo, ingest, jsonl, task_export


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


LINES = """WITH l AS (SELECT conv_id % 8 AS c, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS line, conv_id, turn FROM conversations)
SELECT 'c=' || c AS file, line, """


def _mixed_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of which some are broken, some no objects and some blank, in eight files."""
    t, n = _talk(spark, d), F.col("turn")
    line = F.when(n % 7 == 3, "{broken").when(n % 7 == 5, "[1]").when(n % 7 == 6, "").otherwise(_json(conv=F.col("conv_id"), turn=n))
    lines = t.select((F.col("conv_id") % 8).alias("c"), (F.col("conv_id") * 100_000 + n).alias("n"), line.alias("value"))
    return jsonl.read_json_lines(spark, _written(lines, "mixed-lines"), "*.txt")


@query(LINES + "conv_id AS conv, turn FROM l WHERE turn % 7 NOT IN (3, 5, 6)")
def s1_read_json_lines(spark: SparkSession, d: str) -> DataFrame:
    r = _mixed_lines(spark, d)[0]
    return r.select(F.element_at(F.split("path", "/"), -2).alias("file"), "line", jsonl.at("conv").cast("long").alias("conv"), jsonl.at("turn").cast("long").alias("turn"))


@query(LINES + "CASE turn % 7 WHEN 3 THEN 'invalid JSON' ELSE 'not an object' END AS reason FROM l WHERE turn % 7 IN (3, 5)")
def s1_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_lines(spark, d)[1].select(F.element_at(F.split("path", "/"), -2).alias("file"), "line", "reason")


def _transcripts(spark: SparkSession, d: str) -> ingest.Ingested:
    t = _talk(spark, d)
    used = F.struct(F.col("turn").alias("input_tokens"), F.lit(1).alias("output_tokens"))
    record = _json(type=F.col("role"), uuid=F.concat(F.lit("u"), "turn"), timestamp=F.lit("2024-01-01T00:00:00Z"), gitBranch=F.lit("main"), message=F.struct(F.col("text").alias("content"), used.alias("usage")))
    return ingest.fold_transcripts(t.select(F.concat(F.lit("/p/s"), "conv_id", F.lit(".jsonl")).alias("path"), F.col("turn").alias("line"), record.alias("json")))


@query(FOLDED.format(id="'s' || conv_id"))
def s4_ingest_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _folded(_transcripts(spark, d).blocks)


@query("SELECT 's' || conv_id AS id, CAST(coalesce(sum(turn + 1) FILTER (role <> 'user'), 0) AS BIGINT) AS tokens_used, 'main' AS git_branch, 'p' AS cwd, 'session' AS agent_role FROM conversations GROUP BY conv_id")
def s4_transcript_threads(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).threads.select("id", "tokens_used", "git_branch", "cwd", "agent_role")


@query("SELECT 's' || conv_id AS conversation_id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS kind, count(*) AS n FROM conversations GROUP BY conv_id, 2")
def s4_transcript_census(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).census.select("conversation_id", "kind", "n")


def _streams(spark: SparkSession, d: str) -> ingest.Ingested:
    """Each turn in two chunks and an end; every fifth session has a subagent."""
    t = _talk(spark, d)
    half = F.floor(F.length("text") / 2).cast("int")
    kind = F.when(F.col("role") == "user", "user_message_chunk").otherwise("agent_message_chunk")
    chunk = lambda text: F.struct(kind.alias("sessionUpdate"), F.struct(text.alias("text")).alias("content"))
    end = F.struct(F.lit("turn_completed").alias("sessionUpdate"), F.struct(F.lit("").alias("text")).alias("content"))
    steps = F.array(chunk(F.substring("text", 1, half)), chunk(F.substring(F.col("text"), half + 1, F.length("text"))), end)
    where = F.concat(F.lit("/x/cwd/g"), "conv_id")
    records = t.select(F.concat(where, F.lit("/updates.jsonl")).alias("path"), "turn", F.posexplode(steps).alias("i", "u"))
    records = records.select("path", (F.col("turn") * 3 + F.col("i")).alias("line"), _json(timestamp=F.lit("2024-01-01T00:00:00Z"), params=F.struct(F.col("u").alias("update"))).alias("json"))
    heads = t.select("conv_id").distinct()
    some = heads.filter("conv_id % 5 = 0")
    summaries = heads.filter("conv_id % 2 = 0").select(F.concat(where, F.lit("/summary.json")).alias("path"), _json(generated_title=F.concat(F.lit("title "), "conv_id")).alias("json"))
    metas = some.select(F.concat(where, F.lit("/subagents/a/meta.json")).alias("path"), _json(child_session_id=F.concat(F.lit("k"), "conv_id"), status=F.lit("done")).alias("json"))
    return ingest.fold_update_streams(records, summaries, metas)


@query(FOLDED.format(id="'g' || conv_id"))
def s6_ingest_update_streams(spark: SparkSession, d: str) -> DataFrame:
    return _folded(_streams(spark, d).blocks)


@query("SELECT DISTINCT 'g' || conv_id AS parent, 'k' || conv_id AS child, 'done' AS status FROM conversations WHERE conv_id % 5 = 0")
def s6_stream_edges(spark: SparkSession, d: str) -> DataFrame:
    return _streams(spark, d).edges


@query("SELECT c_custkey::VARCHAR AS id, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_name END, '') AS title, CAST(coalesce(CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END, 0) AS BIGINT) AS tokens_used, '' AS cwd, CAST(NULL AS BIGINT) AS created_at_ms FROM customer WHERE c_custkey % 9 <> 0")
def s7_state_threads(spark: SparkSession, d: str) -> DataFrame:
    """A table of threads with columns missing, nulls in others and blank ids."""
    k = F.col("c_custkey")
    t = demo.read(spark, d, "customer").select(F.when(k % 9 == 0, "").otherwise(k.cast("string")).alias("id"), F.when(k % 4 != 0, F.col("c_name")).alias("title"), F.when(k % 6 != 0, k).alias("tokens_used"))
    return ingest.ingest_state_graph(t)[0].select("id", "title", "tokens_used", "cwd", "created_at_ms")


@query("SELECT c_custkey::VARCHAR AS parent, (c_custkey + 1)::VARCHAR AS child, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'open' END AS status FROM customer WHERE c_custkey % 5 <> 0")
def s7_state_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = demo.read(spark, d, "customer")
    e = c.select(k.cast("string").alias("parent_thread_id"), F.when(k % 5 != 0, (k + 1).cast("string")).alias("child_thread_id"), F.when(k % 3 != 0, "open").alias("status"))
    return ingest.ingest_state_graph(c.select(k.alias("id")), e)[1]


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT 'd' || conv_id AS conversation_id, CAST(i AS INTEGER) AS turn_idx, CASE WHEN role = 'user' THEN 'human' ELSE 'assistant' END AS role, CAST(j AS INTEGER) AS block_idx, CASE WHEN role = 'user' THEN 'text' WHEN j = 0 THEN 'tool_use' ELSE 'tool_result' END AS type,
CASE WHEN role = 'user' THEN md5(coalesce(text, '')) WHEN j = 0 THEN md5('draw') ELSE md5('') END AS text FROM o, (SELECT unnest([0, 1]) AS j) WHERE j = 0 OR role <> 'user'""")
def s10_design_chats(spark: SparkSession, d: str) -> DataFrame:
    """What users say is flat text, what comes back a tool call with its result."""
    call = F.array(F.struct(F.lit("tool_call").alias("type"), F.lit("draw").alias("name"), F.lit("i").alias("input"), F.lit("o").alias("output")))
    said = F.struct(F.col("turn").alias("n"), F.when(F.col("role") == "user", _json(role=F.col("role"), content=F.col("text"))).otherwise(_json(role=F.col("role"), content=F.struct(call.alias("blocks")))).alias("j"))
    doc = _talk(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.j), ",").alias("m"))
    text = F.concat(F.lit('{"id":"d'), "conv_id", F.lit('","title":"t","messages":['), "m", F.lit("]}"))
    found = ingest.ingest_design_chats(spark, _exported(doc.select("conv_id", text.alias("value")), "design-chats"), "*.txt").blocks
    return found.select("conversation_id", F.col("turn_idx").cast("int").alias("turn_idx"), "role", F.col("block_idx").cast("int").alias("block_idx"), "type", F.md5("text").alias("text"))


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A thread a conversation: standing instructions with every third user turn; every fourth answer failed; each text cites a file."""
    t, n = _talk(spark, d), F.col("turn")
    parts = lambda *more: F.array(F.struct(F.lit("text").alias("content_type"), F.col("text"), F.lit(None).cast("string").alias("path")), *more)
    item = lambda content: F.array(F.struct(F.lit("message").alias("type"), content.alias("content")))
    cite = F.struct(F.lit("repo_file_citation").alias("content_type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("f"), n, F.lit(".py")).alias("path"))
    user = _json(role=F.lit("user"), id=F.concat(F.lit("t"), n), custom_instructions=F.when(n % 3 == 0, "be brief"), input_items=item(parts()))
    status = F.concat(F.lit("TaskTurnStatusEnum."), F.when(n % 4 == 1, "FAILED").otherwise("COMPLETED"))
    answer = _json(role=F.lit("assistant"), id=F.concat(F.lit("t"), n), turn_status=status, branch=F.lit("b"), output_items=item(parts(cite)))
    turns = t.select("conv_id", F.struct(n.alias("n"), F.when(F.col("role") == "user", user).otherwise(answer).alias("j")).alias("t"))
    doc = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.j), ",").alias("m"))
    return task_export.task_tables(doc.select(F.concat(F.lit('{"id":"k'), "conv_id", F.lit('","title":"","turns":['), "m", F.lit("]}")).alias("json")))


@query("""WITH o AS (SELECT 'k' || conv_id AS id, role = 'user' AS u, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
b AS (SELECT *, CASE WHEN u AND turn % 3 = 0 THEN [{'t': 'unknown', 'x': '', 'd': 'be brief'}] WHEN NOT u AND turn % 4 = 1 THEN [{'t': 'tool_result', 'x': '', 'd': 'task FAILED'}] ELSE [] END AS first, [{'t': 'text', 'x': text, 'd': CASE WHEN u THEN '' ELSE 'f' || turn || '.py:LNone-LNone' END}] AS said FROM o),
l AS (SELECT *, list_concat(first, said) AS bl FROM b)
SELECT id AS conversation_id, CAST(i AS INTEGER) AS turn_idx, CASE WHEN u THEN 'human' ELSE 'assistant' END AS role, CAST(j - 1 AS INTEGER) AS block_idx, bl[j].t AS type, md5(bl[j].x) AS text, bl[j].d AS detail FROM (SELECT *, unnest(range(1, len(bl) + 1)) AS j FROM l)""")
def s11_task_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = _tasks(spark, d)[1]
    detail = F.coalesce(F.get_json_object("data", "$.name"), F.get_json_object("data", "$.x_raw"), F.get("citations", F.lit(0))["title"], F.lit(""))
    return b.select("conversation_id", "turn_idx", "role", "block_idx", "type", F.md5("text").alias("text"), detail.alias("detail"))


@query("""WITH o AS (SELECT 'k' || conv_id AS id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT id AS conversation_id, CAST(i AS INTEGER) AS turn_idx, 't' || turn AS id, CASE WHEN turn % 4 = 1 THEN 'FAILED' ELSE 'COMPLETED' END AS turn_status, 'b' AS branch, false AS archived FROM o WHERE role <> 'user'""")
def s11_task_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d)[2].select("conversation_id", "turn_idx", "id", "turn_status", "branch", "archived")


@query("""WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT 'b' || conv_id AS conversation_id, CAST(i AS INTEGER) AS turn_idx, printf('n%09d', turn) AS uuid, CAST(CASE WHEN i % 2 = 1 THEN 2 END AS INTEGER) AS "index", CAST(CASE WHEN i % 2 = 1 THEN 2 END AS INTEGER) AS total FROM o""")
def s9_branches(spark: SparkSession, d: str) -> DataFrame:
    """Every second message has an older sibling that was given up: the way leads past it, and says so."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = _talk(spark, d).withColumn("up", F.lag("turn").over(order)).withColumn("i", F.row_number().over(order) - 1)
    name = lambda c: F.when(F.col(c).isNotNull(), F.format_string("n%09d", c))
    said = lambda uuid, when: F.struct(uuid.alias("uuid"), name("up").alias("parent_message_uuid"), F.lit("human").alias("sender"), when.alias("created_at"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    both = F.array(said(name("turn"), F.format_string("2%09d", "turn")), said(F.format_string("x%09d", "turn"), F.format_string("1%09d", "turn")))
    doc = t.select("conv_id", F.explode(F.when(F.col("i") % 2 == 1, both).otherwise(F.slice(both, 1, 1))).alias("m")).groupBy("conv_id").agg(F.collect_list("m").alias("chat_messages"))
    lines = doc.select("conv_id", _json(uuid=F.concat(F.lit("b"), "conv_id"), chat_messages=F.col("chat_messages")).alias("value"))
    b = ingest.ingest_claude_export(spark, _exported(lines, "branches"), "*.txt").blocks
    return b.select("conversation_id", F.col("turn_idx").cast("int").alias("turn_idx"), "uuid", "branch.index", "branch.total")
