"""Ingest of agent logs and chat exports into conversations, blocks, threads and edges.

Each reader returns an Ingested. Folding records into turns is by running islands over line order; only the
walks of message trees, which stay inside one conversation, are functions of its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import account_of, basename, decoded_dir, epoch_to_iso, first_line, flatten_content, iso_to_ms, normalise_prompt, preview, uuid_in
from threadloom.session import ship, stash
from threadloom.sources.jsonl import at, island, read_json_lines
from threadloom.sources.lines import array_elements, file_path, number_runs, number_turns
from threadloom.sources.task_export import task_tables

BLOCK = "conversation_id string, turn_idx int, role string, block_idx int, type string, text string, data string, uuid string, ts string"


@dataclass(frozen=True)
class Ingested:
    """What one source gives; threads and edges are None where the source has no spawn graph."""

    conversations: DataFrame
    blocks: DataFrame
    threads: DataFrame | None = None
    edges: DataFrame | None = None
    errors: DataFrame | None = None
    census: DataFrame | None = None


def _numbered(rows: DataFrame, doc: str) -> DataFrame:
    """Turns numbered from 0 by island, blocks within them by order."""
    turn = F.dense_rank().over(Window.partitionBy(doc).orderBy("turn")) - 1
    block = F.row_number().over(Window.partitionBy(doc, "turn").orderBy("line", "part")) - 1
    return rows.withColumn("turn_idx", turn).withColumn("block_idx", block)


# ---- agent rollouts: {type, timestamp, payload} ----


def ingest_rollouts(spark: SparkSession, path: str, glob: str = "rollout-*.jsonl*") -> Ingested:
    """One JSON-lines file per session; see fold_rollouts()."""
    return fold_rollouts(*read_json_lines(spark, path, glob))


def fold_rollouts(records: DataFrame, errors: DataFrame | None = None) -> Ingested:
    """records (path, line, json); lines rise along a path, which is a session. They are parsed once and kept.

    A user message is a turn of its own; what the assistant side does up to the next one is one turn.

    Developer messages are counted only; reasoning shows its visible summaries; the last cumulative token total
    counts; the id is session_id, id, the UUID in the file name or ''. A parent id is an edge."""
    r = records.select("path", "line", "json", at("type").alias("rtype"), at("timestamp").alias("ts"), at("payload.type").alias("ptype"), at("payload.role").alias("prole"), F.get_json_object("json", "$.payload").alias("payload"))
    r = stash(r, "rollout-records")
    meta = r.filter("rtype = 'session_meta'").groupBy("path").agg(F.min_by("json", "line").alias("meta"))
    tokens = F.when((F.col("rtype") == "event_msg") & (F.col("ptype") == "token_count"), F.expr("try_cast(get_json_object(json, '$.payload.info.total_token_usage.total_tokens') as bigint)"))
    stamped = F.when(F.col("ts") != "", F.col("line"))
    per_file = r.groupBy("path").agg(
        F.max_by(tokens, F.when(tokens.isNotNull(), F.col("line"))).alias("tokens"), F.min_by("ts", stamped).alias("first_ts"), F.max_by("ts", stamped).alias("last_ts"),
        F.sum(((F.col("ptype") == "message") & (F.col("prole") == "developer")).cast("long")).alias("developer_messages"),
    )
    items = r.filter("rtype = 'response_item' and payload is not null and not (ptype = 'message' and prole = 'developer')")
    is_user = (F.col("ptype") == "message") & (F.col("prole") == "user")
    texts = F.from_json(F.get_json_object("payload", "$.content"), "array<struct<type:string,text:string>>")
    said = F.transform(F.filter(texts, lambda p: p.type.isin("input_text", "output_text", "text") & (F.trim(p.text) != "")), lambda p: F.struct(F.lit("text").alias("type"), p.text.alias("text"), F.lit(None).cast("string").alias("data")))
    summary = F.from_json(F.get_json_object("payload", "$.summary"), "array<struct<type:string,text:string>>")
    thought = F.array_join(F.transform(F.filter(summary, lambda p: (p.type == "summary_text") & (F.trim(p.text) != "")), lambda p: p.text), "\n")
    p = lambda n: F.coalesce(F.get_json_object("payload", f"$.{n}"), F.lit(""))
    js = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    one = lambda kind, text, data: F.array(F.struct(F.lit(kind).alias("type"), text.alias("text"), data.alias("data")))
    none = F.lit(None).cast("string")
    blocks = (
        F.when(F.col("ptype") == "message", said)
        .when((F.col("ptype") == "reasoning") & (F.coalesce(thought, F.lit("")) != ""), one("thinking", thought, none))
        .when(F.col("ptype") == "reasoning", F.slice(one("thinking", F.lit(""), none), 1, 0))
        .when(F.col("ptype").isin("function_call", "custom_tool_call"), one("tool_use", p("name"), js(name=p("name"), input=F.coalesce(F.nullif(p("arguments"), F.lit("")), p("input")), call_id=p("call_id"))))
        .when(F.col("ptype").isin("function_call_output", "custom_tool_call_output"), one("tool_result", F.lit(""), js(name=F.lit("output"), content=flatten_content(F.coalesce(_raw("payload", "output"), F.lit('""'))), call_id=p("call_id"))))
        .otherwise(one("unknown", F.lit(""), js(orig_type=F.col("ptype"), x_raw=F.col("payload"))))
    )
    shown = items.withColumn("user", is_user).withColumn("b", F.coalesce(blocks, F.slice(one("text", F.lit(""), none), 1, 0))).filter(F.col("user") | (F.size("b") > 0))
    turns = number_turns(shown.select("path", "line", "user", F.size("b").alias("parts")), "path")
    parts = shown.select("path", "line", "ts", "user", p("id").alias("uuid"), F.posexplode_outer("b").alias("part", "blk"))
    head = per_file.join(meta, "path", "left")
    m = lambda n: F.coalesce(F.get_json_object("meta", f"$.payload.{n}"), F.lit(""))
    ask = parts.filter("user and blk is not null").groupBy("path").agg(F.min_by("blk.text", F.struct("line", "part")).alias("ask"))
    tid = F.coalesce(F.nullif(m("session_id"), F.lit("")), F.nullif(m("id"), F.lit("")), F.nullif(uuid_in(F.col("path")), F.lit("")), F.lit(""))
    title = F.coalesce(F.nullif(first_line(F.col("ask")), F.lit("")), F.nullif(m("agent_nickname"), F.lit("")), F.lit("(untitled)"))
    created = F.coalesce(F.nullif(m("timestamp"), F.lit("")), F.col("first_ts"), F.lit(""))
    docs = head.join(ask, "path", "left").select(
        "path", tid.alias("id"), title.alias("title"), created.alias("created_at"), F.coalesce("last_ts", F.lit("")).alias("updated_at"), F.coalesce("tokens", F.lit(0)).alias("tokens_used"), m("model_provider").alias("model_provider"),
        m("cwd").alias("cwd"), m("git.branch").alias("git_branch"), m("agent_path").alias("agent_role"), m("agent_nickname").alias("agent_nickname"), m("parent_thread_id").alias("parent"), m("thread_source").alias("status"),
        preview(F.col("ask")).alias("preview"), "developer_messages",
    )
    conv = docs.select(F.col("id").alias("conversation_id"), "title", F.lit("codex").alias("provider"), F.lit("").alias("account"), F.col("id").alias("thread_id"), "created_at", "updated_at", "path", "developer_messages")
    threads = docs.select("id", "title", "model_provider", "tokens_used", iso_to_ms(F.col("created_at")).alias("created_at_ms"), iso_to_ms(F.col("updated_at")).alias("updated_at_ms"), "git_branch", "cwd", "agent_role", "agent_nickname", "preview", F.col("path").alias("rollout_path"))
    edges = docs.filter("parent <> '' and id <> ''").select("parent", F.col("id").alias("child"), "status")
    placed = parts.filter("blk is not null").join(turns, ["path", "line"]).withColumn("block_idx", F.col("block_at") + F.col("part"))
    out = placed.join(docs.select("path", F.col("id").alias("conversation_id")), "path")
    return Ingested(conv, _blocks(out), threads, edges, errors)


def _raw(doc: str, name: str) -> Column:
    """A field of a JSON document as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), f"$.{name}", "variant"))


def _blocks(rows: DataFrame) -> DataFrame:
    role = F.when(F.col("user"), "human").otherwise("assistant")
    return rows.select("conversation_id", "turn_idx", role.alias("role"), "block_idx", F.col("blk.type").alias("type"), F.coalesce("blk.text", F.lit("")).alias("text"), F.col("blk.data").alias("data"), "uuid", F.col("ts"))


# ---- per-session transcripts ----


def classify_transcript_path(path: Column) -> Column:
    """struct<kind, session_id, parent_id, workflow, agent_id, child_id> of <slug>/<uuid>.jsonl and the subagent tree below it."""
    parts = F.split(path, "/")
    i = F.array_position(parts, "subagents").cast("int")
    name = F.regexp_replace(basename(path), r"\.jsonl(\.zst)?$", "")
    agent = F.regexp_replace(name, "^agent-", "")
    parent = F.when(i > 1, F.get(parts, i - 2)).otherwise("")
    flow = F.when(F.get(parts, i) == "workflows", F.coalesce(F.get(parts, i + 1), F.lit(""))).otherwise("")
    skipped = F.array_contains(parts, "tool-results")
    child = F.concat_ws(":", parent, F.nullif(flow, F.lit("")), agent)
    sub = i > 0
    return F.struct(
        F.when(skipped, "excluded").when(sub, "subagent").otherwise("session").alias("kind"), F.when(sub, child).otherwise(name).alias("session_id"),
        F.when(sub, parent).otherwise("").alias("parent_id"), F.when(sub, flow).otherwise("").alias("workflow"), F.when(sub, agent).otherwise("").alias("agent_id"),
    )


def ingest_transcripts(spark: SparkSession, path: str) -> Ingested:
    """One JSON-lines file per session or subagent; see fold_transcripts()."""
    return fold_transcripts(*read_json_lines(spark, path, "*.jsonl*"))


def fold_transcripts(records: DataFrame, errors: DataFrame | None = None) -> Ingested:
    """records (path, line, json). The first non-empty generated title, cwd, branch and model win; usage is summed per
    response; a user record of tool results only belongs to the assistant side; a child's path is its edge.

    census (conversation_id, kind, n) counts record types, and by prefix system subtypes, attachment kinds and prompt
    sources, and side chains, meta users, tool result records and branch points."""
    parts_ = F.split("path", "/")
    sub = F.array_position(parts_, "subagents").cast("int")
    slug = F.when(sub > 2, F.get(parts_, sub - 3)).when(sub == 0, F.try_element_at(parts_, F.lit(-2)))
    r = records.withColumn("where", classify_transcript_path(F.col("path"))).filter("where.kind <> 'excluded'")
    r = r.select(
        "path", "line", "json", F.col("where.session_id").alias("sid"), F.col("where.parent_id").alias("parent"), F.col("where.kind").alias("layout"), F.col("where.workflow").alias("workflow"), F.col("where.agent_id").alias("agent_id"), F.coalesce(slug, F.lit("")).alias("slug"),
        at("type").alias("rtype"), at("timestamp").alias("ts"), at("uuid").alias("uuid"), at("parentUuid").alias("puuid"),
    )
    first = lambda p, only=F.lit(True): F.coalesce(F.min_by(at(p), F.when(only & (at(p) != ""), F.col("line"))), F.lit(""))
    answer, talked = F.col("rtype") == "assistant", F.col("rtype").isin("user", "assistant")
    number = lambda p: F.when(answer, F.coalesce(F.expr(f"try_cast(get_json_object(json, '$.message.usage.{p}') as bigint)"), F.lit(0))).otherwise(0)
    stamped = F.when(F.col("ts") != "", F.col("line"))
    spawn = F.when(F.col("layout") == "session", "session").when(F.col("workflow") != "", "workflow").otherwise("subagent")
    docs = r.groupBy("sid").agg(
        F.first("parent").alias("parent"), F.first("path").alias("path"), F.first(spawn).alias("role"), F.first("agent_id").alias("agent_id"), F.first("slug").alias("slug"), first("cwd").alias("cwd"), first("gitBranch").alias("git_branch"),
        first("aiTitle", F.col("rtype") == "ai-title").alias("ai_title"), first("message.model", answer).alias("model_id"), F.sum(number("input_tokens") + number("output_tokens")).alias("tokens_used"), F.min_by("ts", stamped).alias("created_at"), F.max_by("ts", stamped).alias("updated_at"),
    )
    content = _raw("json", "message.content")
    item = "struct<type:string,text:string,thinking:string,name:string,input:string,content:string,tool_use_id:string,is_error:boolean>"
    plain = F.struct(F.lit("text").alias("type"), at("message.content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("thinking", "name", "input", "content", "tool_use_id")], F.lit(None).cast("boolean").alias("is_error"))
    none = F.from_json(F.lit("[]"), f"array<{item}>")
    as_list = F.when(content.startswith("["), F.from_json(content, f"array<{item}>")).when(content.startswith("{"), F.array(F.from_json(content, item))).when(F.trim(at("message.content")) != "", F.array(plain)).otherwise(none)
    talk = r.filter(talked).withColumn("c", as_list).withColumn("results_only", (F.size("c") > 0) & F.forall("c", lambda x: x.type == "tool_result"))
    talk = talk.withColumn("user", (F.col("rtype") == "user") & ~F.col("results_only"))
    talk = talk.filter(F.size("c") > 0)
    turns = number_turns(talk.select("sid", "line", "user", F.size("c").alias("parts")), "sid")
    each = talk.select("sid", "line", "ts", "user", "uuid", F.posexplode("c").alias("part", "x"))
    called = F.to_json(F.struct(F.col("x.name").alias("name"), F.col("x.input").alias("input"), F.col("x.content").alias("content"), F.col("x.tool_use_id").alias("call_id"), F.col("x.is_error").alias("is_error")))
    blk = F.struct(F.coalesce("x.type", F.lit("unknown")).alias("type"), F.coalesce(F.col("x.text"), F.col("x.thinking"), F.lit("")).alias("text"), F.when(F.col("x.type").isin("tool_use", "tool_result"), called).alias("data"))
    out = each.withColumn("blk", blk).join(turns, ["sid", "line"]).withColumn("block_idx", F.col("block_at") + F.col("part")).withColumn("conversation_id", F.col("sid"))
    ask = each.filter("user and x.type = 'text' and x.text is not null").groupBy("sid").agg(F.min_by("x.text", F.struct("line", "part")).alias("ask"))
    d = docs.join(ask, "sid", "left").withColumn("title", F.coalesce(F.nullif("ai_title", F.lit("")), F.nullif(first_line(F.col("ask")), F.lit("")), F.lit("(untitled)")))
    stamps = [F.coalesce(c, F.lit("")).alias(c) for c in ("created_at", "updated_at")]
    conv = d.select(F.col("sid").alias("conversation_id"), "title", F.lit("claude-code").alias("provider"), F.lit("").alias("account"), F.col("sid").alias("thread_id"), *stamps, "path", "model_id")
    threads = d.select(F.col("sid").alias("id"), "title", F.lit("anthropic").alias("model_provider"), "tokens_used", iso_to_ms(F.col("created_at")).alias("created_at_ms"), iso_to_ms(F.col("updated_at")).alias("updated_at_ms"), "git_branch", F.coalesce(F.nullif("cwd", F.lit("")), F.col("slug")).alias("cwd"), F.col("role").alias("agent_role"), F.col("agent_id").alias("agent_nickname"), preview(F.col("ask")).alias("preview"), F.col("path").alias("rollout_path"))
    edges = d.filter("parent <> ''").select("parent", F.col("sid").alias("child"), F.col("role").alias("status"))
    untyped = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(untyped)"))
    speaks = (F.col("rtype") == "user") & ~F.col("results_only")
    kinds = F.array(
        untyped(F.col("rtype")), F.when(F.col("rtype") == "system", F.concat(F.lit("system:"), untyped(at("subtype")))), F.when(F.col("rtype") == "attachment", F.concat(F.lit("attachment:"), untyped(at("attachment.type")))),
        F.when(talked & (at("isSidechain") == "true"), "sidechain"), F.when(F.col("results_only"), "tool_result_record"), F.when(speaks & (at("isMeta") == "true"), "meta_user"), F.when(speaks & (at("promptSource") != ""), F.concat(F.lit("prompt:"), at("promptSource"))),
    )
    results_only = F.coalesce((F.col("rtype") == "user") & (F.size(as_list) > 0) & F.forall(as_list, lambda x: x.type == "tool_result"), F.lit(False))
    counted = r.withColumn("results_only", results_only).select("sid", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).groupBy("sid", "kind").agg(F.count(F.lit(1)).alias("n"))
    forks = r.filter(talked & (F.col("puuid") != "")).groupBy("sid", "puuid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    census = counted.unionByName(forks.select("sid", F.lit("branch_point").alias("kind"), "n"))
    return Ingested(conv, _blocks(out), threads, edges, errors, census.withColumnRenamed("sid", "conversation_id"))


# ---- update streams: one folder per session ----


def ingest_update_streams(spark: SparkSession, path: str) -> Ingested:
    """<cwd>/<session>/updates.jsonl with summary.json beside and subagents/<id>/meta.json below it; see fold_update_streams()."""

    def whole(name: str) -> DataFrame:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
        return found.select(file_path().alias("path"), F.col("value").alias("json"))

    records, errors = read_json_lines(spark, path, "updates.jsonl*")
    return fold_update_streams(records, whole("summary.json"), whole("meta.json"), errors)


def fold_update_streams(records: DataFrame, summaries: DataFrame, metas: DataFrame, errors: DataFrame | None = None) -> Ingested:
    """records (path, line, json), summaries and metas (path, json).

    A session is its folder. Its id is the summary's, the stream's or the folder's name; what the summary says of title,
    times and working directory wins over the stream. Chunks of one kind join without a gap until the kind changes or the turn completes; tool updates of a call
    id fold to one block, each field the last non-empty one; calls without an id never merge; other events are
    counted and break nothing."""
    parts = F.split("path", "/")
    r = records.filter(~F.col("path").contains("/subagents/")).select(
        "path", "line", "json", F.element_at(parts, -2).alias("sid"), decoded_dir(F.element_at(parts, -3)).alias("cwd"), at("timestamp").alias("ts"), at("params.sessionId").alias("hint"), at("params.update.sessionUpdate").alias("kind"),
        at("params.update.content.text").alias("text"), at("params.update.toolCallId").alias("call"), at("params.update.title").alias("title"), at("params.update.status").alias("status"), at("params.update.rawInput").alias("input"), at("params.update.rawOutput").alias("output"),
    )
    chunk = F.col("kind").isin("user_message_chunk", "agent_message_chunk", "agent_thought_chunk")
    tool = F.col("kind").isin("tool_call", "tool_call_update")
    flow = r.filter(chunk | tool | (F.col("kind") == "turn_completed"))
    group = F.when(chunk, F.col("kind")).when(tool & (F.col("call") != ""), F.concat(F.lit("call:"), "call")).when(tool, F.concat(F.lit("line:"), "line")).otherwise("end")
    flow = flow.withColumn("g", group)
    runs = number_runs(flow, "g", "sid")
    # a call keeps the place of its first record wherever its updates come; of the rest each run is a block
    one = F.when(~F.col("g").startswith("call:"), F.col("run"))
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("line")))
    folded = flow.filter("g <> 'end'").join(runs, ["sid", "line"]).groupBy("sid", "g", one.alias("one")).agg(
        F.min("line").alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "").alias("text"), F.min_by("ts", "line").alias("ts"), last("title").alias("name"), last("status").alias("status"), last("input").alias("input"), last("output").alias("output"),
        F.min(F.when(F.col("output") != "", F.col("line"))).alias("out_line"),
    )
    is_tool = F.col("g").startswith("call:") | F.col("g").startswith("line:")
    data = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    main = folded.select("sid", F.col("place").alias("line"), "ts", (F.col("g") == "user_message_chunk").alias("user"), F.struct(
        F.when(is_tool, "tool_use").when(F.col("g") == "agent_thought_chunk", "thinking").otherwise("text").alias("type"), F.when(is_tool, F.coalesce("name", F.lit(""))).otherwise(F.col("text")).alias("text"),
        F.when(is_tool, data(name=F.coalesce("name", F.lit("tool")), input=F.col("input"), status=F.col("status"))).alias("data")).alias("blk"))
    results = folded.filter(is_tool & F.col("out_line").isNotNull()).select("sid", F.col("out_line").alias("line"), "ts", F.lit(False).alias("user"), F.struct(F.lit("tool_result").alias("type"), F.lit("").alias("text"), data(name=F.coalesce("name", F.lit("tool")), content=F.col("output")).alias("data")).alias("blk"))
    rows = main.withColumn("part", F.lit(0)).unionByName(results.withColumn("part", F.lit(1)))
    rows = rows.withColumn("place", F.col("line") * 2 + F.col("part")).drop("line", "part")
    turns = number_turns(rows.select("sid", "place", "user", F.lit(1).alias("parts")), "sid", "place")
    stamped = F.when(F.col("ts") != "", F.col("line"))
    heads = r.groupBy("sid").agg(F.min_by("ts", stamped).alias("first_ts"), F.max_by("ts", stamped).alias("last_ts"), F.first("cwd").alias("dir_cwd"), F.first(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).alias("path"), F.min_by("hint", F.when(F.col("hint") != "", F.col("line"))).alias("hint"))
    sp = F.split("path", "/")
    said = summaries.filter(~F.col("path").contains("/subagents/")).select(F.element_at(sp, -2).alias("sid"), *[at(p).alias(c) for c, p in {"s_id": "info.id", "s_cwd": "info.cwd", "s_title": "generated_title", "s_created": "created_at", "s_active": "last_active_at", "s_updated": "updated_at", "s_kind": "session_kind", "s_agent": "agent_name", "s_model": "current_model_id"}.items()])
    ask = main.filter("user").groupBy("sid").agg(F.min_by("blk.text", "line").alias("ask"))
    best = lambda *cs: F.coalesce(*[F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in cs], F.lit(""))
    d = heads.join(said, "sid", "left").join(ask, "sid", "left").select(
        "sid", best("s_id", "hint", "sid").alias("id"), F.coalesce(F.nullif(best("s_title", first_line(F.col("ask"))), F.lit("")), F.lit("(untitled)")).alias("title"), best("s_cwd", "dir_cwd").alias("cwd"), best("s_created", "first_ts").alias("created_at"),
        best("s_active", "s_updated", "last_ts").alias("updated_at"), best("s_kind").alias("agent_role"), best("s_agent").alias("agent_nickname"), best("s_model").alias("model_id"), preview(F.col("ask")).alias("preview"), "path",
    )
    named = d.select("sid", "id")
    out = rows.join(turns, ["sid", "place"]).withColumn("block_idx", F.col("block_at")).join(named, "sid").withColumn("conversation_id", F.col("id")).withColumn("uuid", F.lit(""))
    conv = d.select(F.col("id").alias("conversation_id"), "title", F.lit("grok").alias("provider"), F.lit("").alias("account"), F.col("id").alias("thread_id"), "created_at", "updated_at", "path", "model_id")
    threads = d.select("id", "title", F.lit("xai").alias("model_provider"), F.lit(0).cast("long").alias("tokens_used"), iso_to_ms(F.col("created_at")).alias("created_at_ms"), iso_to_ms(F.col("updated_at")).alias("updated_at_ms"), F.lit("").alias("git_branch"), "cwd", "agent_role", "agent_nickname", "preview", F.col("path").alias("rollout_path"))
    # a meta without a child gives no edge; one without a parent belongs to the session that it lies in
    below = metas.filter(F.col("path").contains("/subagents/")).select(F.get(sp, F.array_position(sp, "subagents").cast("int") - 2).alias("sid"), at("parent_session_id").alias("given"), at("child_session_id").alias("child"), at("status").alias("status"))
    edges = below.join(named, "sid", "left").filter("child <> ''").select(best("given", "id", "sid").alias("parent"), "child", "status")
    census = r.filter("kind <> ''").groupBy("sid", "kind").agg(F.count(F.lit(1)).alias("n")).join(named, "sid").select(F.col("id").alias("conversation_id"), "kind", "n")
    return Ingested(conv, _blocks(out), threads, edges, errors, census)


# ---- state tables ----

THREAD_DEFAULTS = {"title": "", "model_provider": "", "tokens_used": 0, "created_at_ms": None, "updated_at_ms": None, "git_branch": "", "cwd": "", "agent_role": "", "agent_nickname": "", "preview": "", "rollout_path": ""}


def ingest_state_graph(threads: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Any table of threads: known columns are taken, absent or null ones get defaults; without an id column there
    are no threads; newest first by the first time column there is. Edges need both ends."""
    spark = threads.sparkSession
    kind = lambda v: "long" if v is None or isinstance(v, int) else "string"
    cols = [F.coalesce(F.col(c).cast(kind(v)), F.lit(v).cast(kind(v))).alias(c) if c in threads.columns else F.lit(v).cast(kind(v)).alias(c) for c, v in THREAD_DEFAULTS.items()]
    if "id" in threads.columns:
        by = next((c for c in ("updated_at_ms", "updated_at", "created_at_ms", "created_at") if c in threads.columns), None)
        rows = threads.filter(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
        out = (rows.orderBy(F.col(by).desc_nulls_last(), "id") if by else rows).select(F.col("id").cast("string").alias("id"), *cols)
    else:
        out = threads.limit(0).select(F.lit("").alias("id"), *cols)
    none = spark.createDataFrame([], "parent string, child string, status string")
    if edges is None or not {"parent_thread_id", "child_thread_id"} <= set(edges.columns):
        return out, none
    status = F.coalesce(F.col("status"), F.lit("")) if "status" in edges.columns else F.lit("")
    found = edges.select(F.col("parent_thread_id").alias("parent"), F.col("child_thread_id").alias("child"), status.alias("status"))
    return out, found.filter("coalesce(parent, '') <> '' and coalesce(child, '') <> ''")


# ---- exports ----


def export_records(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, pos, json): the elements of JSON array files, read by many tasks; an object file is one element."""
    return array_elements(spark, path, glob)


def _walk_up(nodes: dict[str, dict], tip: str | None) -> list[str]:
    chain, seen = [], set()
    while tip and tip in nodes and tip not in seen:
        seen.add(tip)
        if nodes[tip]["has_message"]:
            chain.append(tip)
        tip = nodes[tip]["parent"]
    return chain[::-1]


def _active_nodes(rows: list[Row], current: str | None) -> list[tuple]:
    """Of one conversation's nodes those on the path to the current one, or to the best leaf, numbered."""
    nodes = {r["node"]: r for r in rows}
    chain = _walk_up(nodes, current)
    if not chain:
        able = [r for r in nodes.values() if r["has_message"]]
        when = lambda r: -1.0 if r["time"] is None or r["time"] != r["time"] else r["time"]
        best = max(able, key=lambda r: (r["leaf"], when(r)), default=None)
        chain = _walk_up(nodes, best["node"] if best else None)
    return [(node, place) for place, node in enumerate(chain)]


def ingest_chatgpt_export(spark: SparkSession, path: str, glob: str = "conversations*.json") -> Ingested:
    """Message trees: the path that ends at current_node; hidden and system messages drop; assistant messages that
    follow one another are one turn; epoch times become ISO texts."""
    ship(spark)
    docs = stash(export_records(spark, path, glob).withColumn("doc", F.concat_ws("#", "path", "pos")), "export-docs")
    mapping = F.try_variant_get(F.try_parse_json(F.get_json_object("json", "$.mapping")), "$", "map<string,variant>")
    node = docs.select("doc", F.get_json_object("json", "$.current_node").alias("current"), F.explode(F.map_entries(mapping)).alias("e")).select("doc", "current", F.col("e.key").alias("node"), F.to_json("e.value").alias("j"))
    info = node.select("doc", "current", "node", "j", F.get_json_object("j", "$.parent").alias("parent"), F.coalesce(F.get_json_object("j", "$.message").startswith("{"), F.lit(False)).alias("has_message"), F.expr("try_cast(get_json_object(j, '$.message.create_time') as double)").alias("time"), (F.coalesce(F.get_json_object("j", "$.children"), F.lit("[]")) == "[]").alias("leaf"))
    listed = info.groupBy("doc").agg(F.first("current").alias("current"), F.collect_list(F.struct("node", "parent", "has_message", "time", "leaf")).alias("rows"))
    active = listed.select("doc", F.inline(F.udf(_active_nodes, "array<struct<node:string,place:int>>")("rows", "current")))
    m = lambda p: F.coalesce(F.get_json_object("j", f"$.message.{p}"), F.lit(""))
    said = info.join(active, ["doc", "node"]).withColumn("r", F.lower(m("author.role"))).filter((F.col("r") != "system") & (m("metadata.is_visually_hidden_from_conversation") != "true"))
    ctype = m("content.content_type")
    raw_parts = F.try_variant_get(F.try_parse_json(F.get_json_object("j", "$.message.content.parts")), "$", "array<variant>")
    none = F.lit(None).cast("string")
    blk = lambda kind, text, data=none: F.struct(F.lit(kind).alias("type"), text.alias("text"), data.alias("data"))
    data = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))

    def part(v: Column) -> Column:
        s, j = F.try_variant_get(v, "$", "string"), F.to_json(v)
        pt = F.get_json_object(j, "$.content_type")
        ptr = F.coalesce(F.get_json_object(j, "$.asset_pointer"), F.get_json_object(j, "$.audio_asset_pointer.asset_pointer"))
        return (
            F.when(~j.startswith("{"), blk("text", s))
            .when(pt == "audio_transcription", blk("text", F.coalesce(F.get_json_object(j, "$.text"), F.lit(""))))
            .when(ptr.isNotNull(), blk("media", ptr, data(path=basename(ptr), pointer=ptr)))
            .otherwise(blk("unknown", F.lit(""), data(orig_type=pt, x_raw=j)))
        )

    thoughts = F.from_json(F.get_json_object("j", "$.message.content.thoughts"), "array<struct<summary:string,content:string>>")
    texts = F.filter(F.transform(raw_parts, part), lambda b: (b.type != "text") | (F.trim(b.text) != ""))
    blocks = (
        F.when(ctype.isin("thoughts", "reasoning_recap"), F.concat(F.coalesce(F.transform(thoughts, lambda t: F.struct(F.lit("thinking").alias("type"), F.coalesce(F.nullif(t.content, F.lit("")), t.summary, F.lit("")).alias("text"), none.alias("data"))), F.slice(F.array(blk("thinking", F.lit(""))), 1, 0)), F.when(m("content.content") != "", F.array(blk("thinking", m("content.content")))).otherwise(F.slice(F.array(blk("thinking", F.lit(""))), 1, 0))))
        .when(ctype == "code", F.array(blk("code", m("content.text"), data(language=m("content.language")))))
        .when(ctype == "execution_output", F.array(blk("tool_result", F.lit(""), data(name=F.lit("execution_output"), content=m("content.text")))))
        .when(ctype.isin("text", "multimodal_text", ""), texts)
        .otherwise(F.array(blk("unknown", F.lit(""), data(orig_type=ctype, x_raw=F.get_json_object("j", "$.message.content")))))
    )
    rows = said.withColumn("b", blocks).filter(F.size("b") > 0).withColumn("user", F.col("r") == "user").withColumn("line", F.col("place"))
    before = F.lag("user", 1, True).over(Window.partitionBy("doc").orderBy("line"))
    turned = rows.withColumn("new", F.col("user") | before).withColumn("turn", island(F.col("new"), "doc"))
    each = turned.select("doc", "line", "turn", "user", epoch_to_iso(F.col("time")).alias("ts"), m("id").alias("uuid"), F.posexplode("b").alias("part", "blk"))
    top = lambda p: F.coalesce(F.get_json_object("json", f"$.{p}"), F.lit(""))
    cid = F.coalesce(F.nullif(top("id"), F.lit("")), top("conversation_id"))
    stamp = lambda p: epoch_to_iso(F.expr(f"try_cast(get_json_object(json, '$.{p}') as double)"))
    conv = docs.select("doc", cid.alias("conversation_id"), F.coalesce(F.nullif(top("title"), F.lit("")), F.lit("(untitled)")).alias("title"), F.lit("chatgpt").alias("provider"), F.lit("").alias("account"), F.lit("").alias("thread_id"), stamp("create_time").alias("created_at"), stamp("update_time").alias("updated_at"), "path", "pos", F.nullif(top("project_id"), F.lit("")).alias("project"))
    out = _numbered(each, "doc").join(conv.select("doc", "conversation_id"), "doc")
    return Ingested(conv.drop("doc"), _blocks(out))


def _live_path(rows: list[Row] | None) -> list[tuple]:
    """(uuid, place, index, total): messages of one conversation in reading order with their place among siblings.

    From every root, oldest first, down to the child whose subtree holds the newest message; what only cycles
    reach comes last; abandoned siblings stay out."""
    rows = rows or []
    by = {r["uuid"]: r for r in rows}
    kids: dict[str | None, list[dict]] = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r)
    newest = {u: r["ts"] for u, r in by.items()}
    for r in rows:  # carry each message's time up to its ancestors; a seen set ends cycles
        up, seen = r["parent"], {r["uuid"]}
        while up in by and up not in seen:
            seen.add(up)
            newest[up] = max(newest[up], r["ts"])
            up = by[up]["parent"]
    roots = sorted((r for r in rows if r["parent"] not in by), key=lambda r: r["ts"])
    path, seen = [], set()
    for r in roots:
        while r is not None and r["uuid"] not in seen:
            seen.add(r["uuid"])
            sibs = sorted(kids.get(r["parent"], []), key=lambda s: s["ts"])
            path.append((r["uuid"], sibs.index(r) + 1 if len(sibs) > 1 else None, len(sibs) if len(sibs) > 1 else None))
            below = kids.get(r["uuid"])
            r = max(below, key=lambda k: (newest[k["uuid"]], k["ts"])) if below else None
    reach, todo = set(), [r["uuid"] for r in roots]
    while todo:
        u = todo.pop()
        if u not in reach:
            reach.add(u)
            todo += [k["uuid"] for k in kids.get(u, [])]
    path += [(r["uuid"], None, None) for r in sorted(rows, key=lambda r: r["ts"]) if r["uuid"] not in reach]
    return [(uuid, place, index, total) for place, (uuid, index, total) in enumerate(path)]


def _placed(rows: list[Row] | None) -> list[tuple]:
    """(at, place, index, total): what _live_path() says of each row, by the row's own place in rows; rows without a name have none."""
    at: dict[str, list[int]] = {}
    for i, r in enumerate(rows or []):
        at.setdefault(r["uuid"], []).append(i)
    return [(i, place, index, total) for uuid, place, index, total in _live_path(rows) if uuid is not None for i in at[uuid]]


def ingest_claude_export(spark: SparkSession, path: str, glob: str = "conversations*.json") -> Ingested:
    """Messages linked by parent; blocks also carry branch {index, total} where a message has siblings."""
    ship(spark)
    docs = stash(export_records(spark, path, glob).withColumn("doc", F.concat_ws("#", "path", "pos")), "export-docs")
    content = "array<struct<type:string,text:string,thinking:string,name:string,input:string,content:string,display_content:string,is_error:boolean,citations:array<struct<title:string,url:string>>>>"
    message = f"array<struct<uuid:string,parent_message_uuid:string,sender:string,created_at:string,content:{content},attachments:array<struct<file_name:string,file_type:string,file_size:string,extracted_content:string>>,files:array<struct<file_name:string,file_uuid:string>>>>"
    said = F.from_json(F.get_json_object("json", "$.chat_messages"), message)
    top = lambda p: F.coalesce(F.get_json_object("json", f"$.{p}"), F.lit(""))
    # a conversation's messages are placed in its row, and leave it with their places: nothing is joined, no text moves
    told = docs.select(top("uuid").alias("conversation_id"), said.alias("said"))
    tree = F.transform("said", lambda m: F.struct(m.uuid.alias("uuid"), m.parent_message_uuid.alias("parent"), F.coalesce(m.created_at, F.lit("")).alias("ts")))
    told = told.withColumn("placed", F.udf(_placed, "array<struct<at:int,place:int,index:int,total:int>>")(tree))
    placed = told.select("conversation_id", F.explode(F.transform("placed", lambda p: F.struct(F.get("said", p["at"]).alias("m"), p.place.alias("place"), p["index"].alias("index"), p.total.alias("total")))).alias("p"))
    msgs = placed.select("conversation_id", "p.*")
    none = F.lit(None).cast("string")
    cites = "array<struct<title:string,url:string>>"
    blk = lambda kind, text, data=none, c=None: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), F.coalesce(text, F.lit("")).alias("text"), data.alias("data"), (F.lit(None).cast(cites) if c is None else c).alias("citations"))
    data = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    hidden = ("token_budget", "flag")
    known = ("text", "thinking", "tool_use", "tool_result")
    item = lambda x: blk(F.when(x.type.isin(*known), x.type).otherwise("unknown"), F.when(x.type == "text", x.text).when(x.type == "thinking", x.thinking).otherwise(x.display_content), F.when(x.type.isin("tool_use", "tool_result"), data(name=x["name"], input=x["input"], content=x.content, is_error=x.is_error)).when(~x.type.isin(*known), data(orig_type=x.type)), F.when(x.type == "text", x.citations))
    empty = F.slice(F.array(blk("text", F.lit(""))), 1, 0)
    b = F.concat(
        F.coalesce(F.transform("m.attachments", lambda a: blk("attachment", a.file_name, data(file_name=a.file_name, file_type=a.file_type, file_size=a.file_size, extracted_content=a.extracted_content))), empty),
        F.coalesce(F.transform("m.files", lambda f: blk("file", f.file_name, data(file_name=f.file_name, file_uuid=f.file_uuid))), empty),
        F.coalesce(F.transform(F.filter("m.content", lambda x: ~x.type.isin(*hidden)), item), empty),
    )
    branch = F.when(F.col("index").isNotNull(), F.struct("index", "total"))
    account = F.coalesce(account_of(F.get_json_object("json", "$.account")), F.lit(""))
    conv = docs.select(top("uuid").alias("conversation_id"), F.coalesce(F.nullif(top("name"), F.lit("")), F.lit("(untitled)")).alias("title"), F.lit("claude").alias("provider"), account.alias("account"), F.lit("").alias("thread_id"), top("created_at").alias("created_at"), top("updated_at").alias("updated_at"), "path", "pos", F.nullif(top("project_uuid"), F.lit("")).alias("project"))
    each = msgs.select("conversation_id", F.col("m.uuid").alias("uuid"), (F.col("m.sender") == "human").alias("user"), F.coalesce("m.created_at", F.lit("")).alias("ts"), F.col("place").alias("turn_idx"), branch.alias("branch"), F.posexplode(b).alias("block_idx", "blk"))
    role = F.when(F.col("user"), "human").otherwise("assistant")
    blocks = each.select("conversation_id", "turn_idx", role.alias("role"), "block_idx", "blk.type", "blk.text", "blk.data", "uuid", "ts", "branch", "blk.citations")
    return Ingested(conv, blocks)


def ingest_design_chats(spark: SparkSession, path: str, glob: str = "*.json") -> Ingested:
    """The second shape: messages with role and a content object of blocks, or flat text; a tool call gives its use
    and its result."""
    docs = export_records(spark, path, glob).filter(F.get_json_object("json", "$.messages").isNotNull())
    part = "array<struct<type:string,text:string,name:string,input:string,output:string>>"
    msgs = docs.select(at("id").alias("id"), at("uuid").alias("uuid"), at("title").alias("title"), at("name").alias("name"), at("created_at").alias("created_at"), F.posexplode(F.try_variant_get(F.try_parse_json(F.get_json_object("json", "$.messages")), "$", "array<variant>")).alias("line", "v"))
    cid = F.coalesce(F.nullif("id", F.lit("")), F.col("uuid"))
    msgs = msgs.select(cid.alias("conversation_id"), F.coalesce(F.nullif("title", F.lit("")), F.nullif("name", F.lit("")), F.lit("(untitled)")).alias("title"), "created_at", "line", F.to_json("v").alias("json"))
    none = F.lit(None).cast("string")
    given = F.from_json(F.get_json_object("json", "$.content.blocks"), part)
    flat = F.coalesce(F.get_json_object("json", "$.content.text"), F.get_json_object("json", "$.content"), F.lit(""))
    one = lambda kind, text, data: F.struct(F.lit(kind).alias("type"), F.coalesce(text, F.lit("")).alias("text"), data.alias("data"))
    pair = lambda x: F.when(x.type == "tool_call", F.array(one("tool_use", x["name"], F.to_json(F.struct(x["name"].alias("name"), x["input"].alias("input")))), one("tool_result", F.lit(""), F.to_json(F.struct(x["name"].alias("name"), x["output"].alias("content")))))).otherwise(F.array(one("text", x.text, none)))
    b = F.when(given.isNotNull(), F.flatten(F.transform(given, pair))).otherwise(F.array(one("text", flat, none)))
    each = msgs.select("conversation_id", F.col("line").alias("turn_idx"), at("role").isin("user", "human").alias("user"), at("created_at").alias("ts"), at("uuid").alias("uuid"), F.posexplode(b).alias("block_idx", "blk"))
    conv = msgs.groupBy("conversation_id").agg(F.first("title").alias("title"), F.first("created_at").alias("created_at")).select("conversation_id", "title", F.lit("claude").alias("provider"), F.lit("").alias("account"), F.lit("").alias("thread_id"), "created_at", F.col("created_at").alias("updated_at"))
    return Ingested(conv, _blocks(each))


def ingest_task_export(spark: SparkSession, path: str) -> Ingested:
    """Threads of turns with input or output items: messages, pull requests, diffs, snapshots; an unfinished turn begins with its
    status; citations attach to the text run before them. What is known of the turns is in the census."""
    conversations, blocks, census = task_tables(export_records(spark, path, "codex.json"))
    return Ingested(conversations, blocks, census=census)


# ---- activity logs ----


def activity_turns(records: DataFrame, doc: str = "doc") -> DataFrame:
    """records (doc, pos, ts, verb, title, detail, prompt, response) and, if there, attachments and media as JSON arrays:
    a prompt gives a human and an assistant turn, any other verb one event; attached things stand before a prompt and
    after an event. (conversation_id, turn_idx, role, block_idx, type, text, data, ts)."""
    text = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    verb = F.coalesce(F.nullif("verb", F.lit("")), F.lit("Prompted"))
    none = F.lit(None).cast("string")
    blk = lambda kind, t, data=none: F.struct(F.lit(kind).alias("type"), t.alias("text"), data.alias("data"))
    empty = F.slice(F.array(blk("text", F.lit(""))), 1, 0)

    def each_of(column: str, shown: Callable[[Column, Column], Column]) -> Column:
        """Blocks of a JSON array's elements; shown gets the element as JSON and, if it is one, its string."""
        if column not in records.columns:
            return empty
        elements = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
        return F.coalesce(F.transform(elements, lambda v: shown(F.to_json(v), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(""))), empty)

    field = lambda j, *names: F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{n}"), F.lit("")) for n in names], F.lit(""))
    js = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    held = lambda j, s: F.when(
        j.startswith("{"), blk("attachment", F.coalesce(F.nullif(field(j, "name"), F.lit("")), F.lit("attachment")), js(file_name=field(j, "name"), path=field(j, "on_disk"), resolved=field(j, "resolved") == "true"))
    ).otherwise(blk("attachment", F.coalesce(F.nullif(s, F.lit("")), F.lit("attachment")), js(file_name=s)))
    at_path = lambda p: blk("media", p, js(path=p))
    attached = F.concat(each_of("attachments", held), each_of("media", lambda j, s: F.when(j.startswith("{"), at_path(field(j, "on_disk", "name"))).otherwise(at_path(s))))
    turn = lambda role, blocks: F.struct(F.lit(role).alias("role"), blocks.alias("blocks"))
    both = F.array(turn("human", F.concat("attached", F.array(blk("text", text("prompt", "title", "detail"))))), turn("assistant", F.array(blk("text", text("response")))))
    event = F.array(turn("assistant", F.concat(F.array(blk("event", text("title", "detail", "verb"), js(name=verb, detail=text("detail")))), F.col("attached"))))
    each = records.withColumn("attached", attached).select(doc, "pos", "ts", F.posexplode(F.when(verb == "Prompted", both).otherwise(event)).alias("part", "t"))
    numbered = each.withColumn("turn_idx", F.row_number().over(Window.partitionBy(doc).orderBy("pos", "part")) - 1)
    out = numbered.select(F.col(doc).alias("conversation_id"), "turn_idx", "t.role", F.posexplode("t.blocks").alias("block_idx", "b"), "ts")
    return out.select("conversation_id", "turn_idx", "role", "block_idx", "b.type", "b.text", "b.data", "ts")


def ingest_activity_log(spark: SparkSession, path: str, glob: str = "*.json", gap_ms: int | None = None) -> Ingested:
    """Activity records as a JSON array: each file one conversation, or one for each run of a gem without a longer gap."""
    raw = export_records(spark, path, glob)
    given = lambda *names: F.coalesce(*[F.nullif(at(n), F.lit("")) for n in names], F.lit(""))
    arrays = lambda n: F.get_json_object("json", f"$.{n}").alias(n)
    r = raw.select("path", "pos", given("timestamp_iso", "timestamp").alias("ts"), at("verb").alias("verb"), at("gem").alias("gem"), at("prompt").alias("prompt"), at("response_md").alias("response"), at("title").alias("title"), at("detail").alias("detail"), arrays("attachments"), arrays("media"))
    if gap_ms is None:
        r = r.withColumn("doc", F.col("path")).withColumn("grp", F.lit("all"))
    else:
        r = group_by_gap(r.withColumn("ts_ms", iso_to_ms(F.col("ts"))), "path", gap_ms).withColumn("doc", F.concat_ws("#", "path", "grp"))
    heads = activity_conversations(r).join(r.select(F.col("doc").alias("conversation_id"), "path").distinct(), "conversation_id")
    title = F.lit("Gemini activity (ungrouped)") if gap_ms is None else F.lit("(untitled)")
    conv = heads.select("conversation_id", title.alias("title"), F.lit("gemini").alias("provider"), F.lit("").alias("account"), F.lit("").alias("thread_id"), "created_at", "updated_at", "path", "gems")
    return Ingested(conv, activity_turns(r).withColumn("uuid", F.lit("")))


def activity_conversations(records: DataFrame, doc: str = "doc") -> DataFrame:
    """(conversation_id, created_at, updated_at, gems): first and last stamp in record order, gems once each in order."""
    stamped = F.when(F.col("ts") != "", F.col("pos"))
    return records.groupBy(F.col(doc).alias("conversation_id")).agg(
        F.coalesce(F.min_by("ts", stamped), F.lit("")).alias("created_at"), F.coalesce(F.max_by("ts", stamped), F.lit("")).alias("updated_at"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("gem", F.lit("")) != "", F.struct("pos", "gem")))), lambda x: x.gem)).alias("gems"),
    )


def group_by_gap(records: DataFrame, by: str | None = None, gap_ms: int = 30 * 60 * 1000) -> DataFrame:
    """records (pos, ts_ms, gem) with grp: a new group where the last known stamp is strictly more than the gap
    before, or the gem changes. by: a column that keeps logs apart; without it one log is one ordered sequence."""
    keys = [by] if by else []
    order = Window.partitionBy(*keys).orderBy("pos")
    known = F.last("ts_ms", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.lag("pos").over(order).isNull()
    new = first | F.coalesce(F.col("ts_ms") - known > gap_ms, F.lit(False)) | ~F.col("gem").eqNullSafe(F.lag("gem").over(order))
    n = F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("grp", F.format_string("grp%03d", n))


def group_by_harvest(records: DataFrame, harvest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with grp, matched count): the k-th harvested user turn with a prompt takes the k-th record with it.

    records (pos, prompt), harvest (id, turn, text) in order of (id, turn); leftovers go to 'unmatched'."""
    k = lambda *o: F.row_number().over(Window.partitionBy("p").orderBy(*o))
    r = records.withColumn("p", normalise_prompt(F.col("prompt"))).withColumn("k", k("pos"))
    h = harvest.select(F.col("id").alias("grp"), "turn", normalise_prompt(F.col("text")).alias("p")).withColumn("k", k("grp", "turn")).select("p", "k", "grp")
    joined = r.join(h, ["p", "k"], "left").withColumn("grp", F.when(F.col("p") == "", F.lit(None)).otherwise(F.col("grp")))
    out = joined.withColumn("grp", F.coalesce("grp", F.lit("unmatched"))).drop("p", "k")
    return out, out.agg(F.sum((F.col("grp") != "unmatched").cast("long")).alias("matched"))


# ---- admission and merging ----


def resolve_export_files(listing: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of listing (source, path): files of the real name, else any .json; a source with none is an error."""
    named = F.lower(basename(F.col("path"))).rlike(pattern)
    json = F.lower(F.col("path")).endswith(".json")
    has = F.max(named.cast("int")).over(Window.partitionBy("source"))
    files = listing.withColumn("has", has).filter(F.when(F.col("has") == 1, named).otherwise(json)).drop("has")
    missing = listing.select("source").distinct().join(files.select("source").distinct(), "source", "left_anti").select("source", F.lit("no export file").alias("reason"))
    return files, missing


def dedup_across_shards(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, repeats per path) of docs (conversation_id, path, pos, project, ...): the first copy stays, with the
    project of any; blank ids never repeat one another."""
    key = F.when(F.trim("conversation_id") == "", F.concat_ws("#", F.lit("blank"), "path", "pos")).otherwise(F.col("conversation_id"))
    order = Window.partitionBy("_k").orderBy("path", "pos")
    every = Window.partitionBy("_k").orderBy("path", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = docs.withColumn("_k", key).withColumn("_n", F.row_number().over(order)).withColumn("project", F.first("project", ignorenulls=True).over(every))
    repeats = marked.filter("_n > 1").groupBy("path").agg(F.count(F.lit(1)).alias("repeats"))
    return marked.filter("_n = 1").drop("_n", "_k"), repeats


def admit_documents(docs: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(admitted, errors, edges) of docs (conversation_id, source, priority, path, ...).

    An id belongs to the first source that claims it; other sources' documents and the edges they declare
    (source, parent, child) are refused. A blank id claims nothing and gets 'unidentified:<file>' as its key."""
    blank = F.trim("conversation_id") == ""
    owner = F.min(F.when(~blank, F.struct("priority", "source"))).over(Window.partitionBy(F.when(blank, F.concat_ws("#", F.lit("blank"), "path")).otherwise(F.col("conversation_id"))))
    marked = docs.withColumn("_o", owner)
    mine = blank | (F.col("_o.source") == F.col("source"))
    key = F.when(blank, F.concat(F.lit("unidentified:"), basename(F.col("path")))).otherwise(F.col("conversation_id"))
    admitted = marked.filter(mine).withColumn("conversation_id", key).drop("_o")
    errors = marked.filter(~mine).select("conversation_id", "source", F.concat(F.lit("id belongs to "), "_o.source").alias("reason"))
    if edges is None:
        return admitted, errors, None
    refused = errors.select(F.col("conversation_id").alias("child"), "source").distinct()
    return admitted, errors, edges.join(refused, ["child", "source"], "left_anti")


def fold_resumed_legs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, divergent) of turns (conversation_id, leg, turn_idx, uuid, role, ts, text): legs of one id in order.

    A turn's key is its uuid, else role, stamp and text. It stands where it was first seen; a later one of the
    same uuid with more characters replaces its text there, and each such growth is counted. The first leg is
    kept whole, repeats inside it included."""
    key = F.when(F.col("uuid") != "", F.concat(F.lit("u:"), "uuid")).otherwise(F.concat_ws("|", F.lit("t"), "role", "ts", "text"))
    same = Window.partitionBy("conversation_id", "key")
    order = same.orderBy("leg", "turn_idx")
    first_leg = F.min("leg").over(Window.partitionBy("conversation_id"))
    t = turns.withColumn("key", key).withColumn("first_leg", first_leg).withColumn("n", F.row_number().over(order)).withColumn("size", F.length("text"))
    best = F.max("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("grew", (F.col("uuid") != "") & (F.col("leg") > F.col("first_leg")) & F.coalesce(F.col("size") > best, F.lit(False)))
    longest = F.max(F.when(F.col("grew"), F.struct("size", (-F.col("leg")).alias("l"), (-F.col("turn_idx")).alias("i"), "text"))).over(same)
    kept = t.withColumn("longest", longest).filter((F.col("n") == 1) | (F.col("leg") == F.col("first_leg")))
    kept = kept.withColumn("text", F.when(F.col("n") == 1, F.coalesce("longest.text", "text")).otherwise(F.col("text")))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("leg", "turn_idx")) - 1
    merged = kept.withColumn("place", place).select("conversation_id", F.col("place").alias("turn_idx"), "uuid", "role", "ts", "text")
    return merged, t.groupBy("conversation_id").agg(F.sum(F.col("grew").cast("long")).alias("divergent"))


def fold_leg_heads(legs: DataFrame) -> DataFrame:
    """legs (conversation_id, leg, title, path, updated_at, tokens_used): title of the first, path of the last, the
    greatest stamp and tokens, and the ordered leg list."""
    return legs.groupBy("conversation_id").agg(
        F.min_by("title", "leg").alias("title"), F.max_by("path", "leg").alias("path"), F.max("updated_at").alias("updated_at"), F.max("tokens_used").alias("tokens_used"),
        F.transform(F.array_sort(F.collect_list(F.struct("leg", "path"))), lambda x: x.path).alias("legs"),
    )


def merge_graph(sources: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Threads and edges of sources in order of trust: the earlier one wins a thread id and an edge's status."""

    def first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
        every = frames[0].withColumn("_p", F.lit(0))
        for i, f in enumerate(frames[1:], 1):
            every = every.unionByName(f.withColumn("_p", F.lit(i)), allowMissingColumns=True)
        rest = [c for c in every.columns if c not in keys and c != "_p"]
        return every.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_p").alias("r")).select(*keys, "r.*")

    return first([t for t, _ in sources], ["id"]), first([e for _, e in sources], ["parent", "child"])


def source_inventory(listing: DataFrame, keep: int = 25) -> DataFrame:
    """listing (path, bytes, mtime) classified by name: (provider, kind, path, confidence, ambiguous, count, newest, truncated).

    Stores count their sessions; exports of one name are told apart by what lies beside them, else ambiguous. Of
    each provider and kind the newest keep are listed, and truncated says that there are more."""
    parts = F.split("path", "/")
    l = listing.withColumn("name", F.lower(F.element_at(parts, -1))).withColumn("dir", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))  # noqa: E741
    has = lambda *names: F.max(F.col("name").isin(*names))
    beside = l.groupBy("dir").agg(has("chat.html").alias("gpt"), has("users.json", "memories.json", "projects.json").alias("cl"))
    l = l.join(beside, "dir")  # noqa: E741
    gpt, cl = F.col("gpt"), F.col("cl")
    is_conv = F.col("name") == "conversations.json"
    rule = lambda provider, kind, sure, where: F.struct(F.lit(provider).alias("p"), F.lit(kind).alias("k"), F.lit(sure).alias("c"), where.alias("w"))
    under = lambda folder: F.regexp_extract("dir", f"^(.*/{folder})", 1)
    rules = (
        F.when(F.col("name").rlike(r"^rollout-.*\.jsonl(\.zst)?$") & F.col("dir").contains("/sessions"), rule("codex", "store", "high", under("sessions")))
        .when((F.col("name") == "updates.jsonl") & ~F.col("dir").contains("/subagents/"), rule("grok", "store", "high", under("sessions")))
        .when(F.col("name").endswith(".jsonl") & F.col("dir").rlike("/projects/[^/]+$"), rule("claude-code", "store", "high", under("projects")))
        .when(is_conv & gpt & ~cl, rule("chatgpt", "export", "high", F.col("path")))
        .when(is_conv & cl & ~gpt, rule("claude", "export", "high", F.col("path")))
        .when(is_conv, rule("chatgpt|claude", "export", "low", F.col("path")))
        .when(F.col("name").rlike(r"^conversations-.*\.json$"), rule("chatgpt", "export", "medium", F.col("path")))
        .when(F.col("name") == "codex.json", rule("codex", "export", "high", F.col("path")))
        .when((F.col("name") == "transcript.json") & F.col("dir").rlike("Gemini|Takeout"), rule("gemini", "export", "medium", F.col("path")))
        .when(F.col("name") == "transcript.json", rule("gemini", "export", "low", F.col("path")))
    )
    found = l.withColumn("r", rules).filter("r is not null").groupBy(F.col("r.p").alias("provider"), F.col("r.k").alias("kind"), F.col("r.w").alias("path")).agg(F.min("r.c").alias("confidence"), F.count(F.lit(1)).alias("count"), F.max("mtime").alias("newest"))
    group = Window.partitionBy("provider", "kind")
    ranked = found.withColumn("_n", F.row_number().over(group.orderBy(F.col("newest").desc(), "path"))).withColumn("truncated", F.count(F.lit(1)).over(group) > keep)
    return ranked.filter(F.col("_n") <= keep).drop("_n").withColumn("ambiguous", F.col("provider").contains("|"))


#: Readers by name; add one by putting a function (spark, path) -> Ingested here.
ADAPTERS: dict[str, Callable[[SparkSession, str], Ingested]] = {
    "rollouts": ingest_rollouts,
    "transcripts": ingest_transcripts,
    "update_streams": ingest_update_streams,
    "chatgpt_export": ingest_chatgpt_export,
    "claude_export": ingest_claude_export,
    "design_chats": ingest_design_chats,
    "task_export": ingest_task_export,
    "activity_log": ingest_activity_log,
}


def with_conversations(found: Ingested, conversations: DataFrame) -> Ingested:
    """found with only these conversations, and the blocks that belong to them."""
    return replace(found, conversations=conversations, blocks=found.blocks.join(conversations.select("conversation_id"), "conversation_id", "left_semi"))
