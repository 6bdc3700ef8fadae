import json

import zstandard

from pyspark.sql import functions as F

from threadloom.sources import ingest, jsonl
from threadloom.streaming import incremental


def put(path, *rows, text=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if text is not None else "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def shown(blocks):
    return [tuple(r) for r in blocks.orderBy("conversation_id", "turn_idx", "block_idx").select("turn_idx", "role", "block_idx", "type", "text").collect()]


def test_json_lines_quarantine_and_plain_first(spark, tmp_path):
    put(tmp_path / "a/x.jsonl", {"k": 1}, "", "nope", [1], {"k": 2})
    (tmp_path / "a/x.jsonl.zst").write_bytes(zstandard.compress(b'{"k": 9}'))
    (tmp_path / "a/y.jsonl.zst").write_bytes(zstandard.compress(b'{"k": 3}'))
    put(tmp_path / "a/z.jsonl.zst", text="no frame")
    records, errors = jsonl.read_json_lines(spark, str(tmp_path))
    assert [(r.line, json.loads(r.json)["k"]) for r in records.orderBy("line", "path").collect()] == [(1, 1), (1, 3), (5, 2)]
    assert [(r.line, r.reason) for r in errors.orderBy("line").collect()] == [(0, "unreadable file"), (3, "invalid JSON"), (4, "not an object")]


def test_rollouts(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "timestamp": "2024-01-01T00:00:05Z", "payload": p}
    say = lambda role, text: item(type="message", role=role, id=f"m{text}", content=[{"type": "input_text", "text": text}, {"type": "other", "text": "x"}])
    total = lambda n: {"type": "event_msg", "timestamp": "", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": n}}}}
    put(
        tmp_path / "s/rollout-1.jsonl",
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "T1", "cwd": "/w", "git": {"branch": "main"}, "parent_thread_id": "T0", "thread_source": "spawn", "model_provider": "openai"}},
        say("developer", "rules"), say("user", "first\nline"), item(type="reasoning", summary=[{"type": "summary_text", "text": "hm"}]), item(type="reasoning", encrypted_content="?"),
        item(type="function_call", name="run", arguments="{}", call_id="c1"), item(type="function_call_output", call_id="c1", output="done"), say("assistant", "ok"), total(10), total(25), {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
        say("user", "again"), item(type="new_thing", x=1), {"type": "response_item", "timestamp": "2024-01-02T00:00:00Z", "payload": {"type": "message", "role": "assistant", "content": []}},
    )
    put(tmp_path / "s/rollout-2-01234567-89ab-cdef-0123-456789abcdef.jsonl", say("user", "no meta"))
    got = ingest.ingest_rollouts(spark, str(tmp_path))
    t = {r.id: r for r in got.threads.collect()}
    assert set(t) == {"T1", "01234567-89ab-cdef-0123-456789abcdef"}
    assert (t["T1"].title, t["T1"].tokens_used, t["T1"].git_branch, t["T1"].created_at_ms, t["T1"].updated_at_ms) == ("first", 25, "main", 1704067200000, 1704153600000)
    assert [tuple(r) for r in got.edges.collect()] == [("T0", "T1", "spawn")]
    assert got.conversations.filter("conversation_id = 'T1'").first().developer_messages == 1
    one = got.blocks.filter("conversation_id = 'T1'")
    assert shown(one) == [(0, "human", 0, "text", "first\nline"), (1, "assistant", 0, "thinking", "hm"), (1, "assistant", 1, "tool_use", "run"), (1, "assistant", 2, "tool_result", ""), (1, "assistant", 3, "text", "ok"), (2, "human", 0, "text", "again"), (3, "assistant", 0, "unknown", "")]
    assert json.loads(one.filter("type = 'tool_result'").first().data)["content"] == "done"


def test_transcripts_and_their_paths(spark, tmp_path):
    rec = lambda kind, uuid, content, **kw: {"type": kind, "uuid": uuid, "timestamp": "2024-01-01T00:00:00Z", "message": {"content": content, **kw.pop("m", {})}, **kw}
    put(
        tmp_path / "proj/S1.jsonl",
        rec("user", "1", "hello", cwd="/w", gitBranch="dev"), rec("assistant", "2", [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls", "input": {"a": 1}}], parentUuid="1", m={"model": "m1", "usage": {"input_tokens": 3, "output_tokens": 4}}),
        rec("user", "3", [{"type": "tool_result", "content": "out", "tool_use_id": "x"}], parentUuid="2"), rec("assistant", "4", [{"type": "text", "text": "bye"}], parentUuid="2", m={"usage": {"output_tokens": 5}}), {"type": "system", "subtype": "s"},
    )
    put(tmp_path / "proj/S1/subagents/agent-A.jsonl", rec("user", "9", "sub"))
    put(tmp_path / "proj/S1/tool-results/z.jsonl", rec("user", "8", "never"))
    put(
        tmp_path / "proj/S2.jsonl",
        {"type": "ai-title", "aiTitle": "named"}, rec("user", "1", "ask", isMeta=True, promptSource="typed"), rec("user", "2", [{"type": "tool_result", "content": "bad", "tool_use_id": "x", "is_error": True}], isSidechain=True), rec("assistant", "3", "   "), {"type": "attachment", "attachment": {"type": "diff"}}, {},
    )
    put(tmp_path / "proj/S1/subagents/workflows/w1/agent-B.jsonl", rec("user", "7", "flow"))
    got = ingest.ingest_transcripts(spark, str(tmp_path))
    assert {r.id: (r.tokens_used, r.title, r.agent_role, r.agent_nickname, r.cwd) for r in got.threads.collect()} == {
        "S1": (12, "hello", "session", "", "/w"), "S1:A": (0, "sub", "subagent", "A", "proj"), "S1:w1:B": (0, "flow", "workflow", "B", "proj"), "S2": (0, "named", "session", "", "proj"),
    }
    assert sorted(tuple(r) for r in got.edges.collect()) == [("S1", "S1:A", "subagent"), ("S1", "S1:w1:B", "workflow")]
    assert [r.data for r in got.blocks.filter("conversation_id = 'S2' and type = 'tool_result'").collect()] == ['{"content":"bad","call_id":"x","is_error":true}']
    own = {r.kind: r.n for r in got.census.filter("conversation_id = 'S2'").collect()}
    assert own == {"ai-title": 1, "user": 2, "assistant": 1, "attachment": 1, "(untyped)": 1, "attachment:diff": 1, "sidechain": 1, "tool_result_record": 1, "meta_user": 1, "prompt:typed": 1}
    assert shown(got.blocks.filter("conversation_id = 'S1'")) == [(0, "human", 0, "text", "hello"), (1, "assistant", 0, "text", "hi"), (1, "assistant", 1, "tool_use", ""), (1, "assistant", 2, "tool_result", ""), (1, "assistant", 3, "text", "bye")]
    census = {(r.conversation_id, r.kind): r.n for r in got.census.collect()}
    assert census[("S1", "branch_point")] == 1 and census[("S1", "system")] == 1


def test_update_streams(spark, tmp_path):
    up = lambda kind, **u: {"timestamp": "2024-01-01T00:00:00Z", "params": {"sessionId": "S", "update": {"sessionUpdate": kind, **u}}}
    chunk = lambda kind, t: up(kind, content={"text": t})
    put(
        tmp_path / "%2Fw/S/updates.jsonl",
        chunk("user_message_chunk", "do "), chunk("user_message_chunk", "it"), chunk("agent_message_chunk", "sure"), up("mode_change"), chunk("agent_message_chunk", " thing"),
        up("tool_call", toolCallId="c", title="ls", rawInput="i"), chunk("agent_message_chunk", "then"), up("tool_call_update", toolCallId="c", rawOutput="o", status="done"), up("turn_completed"), chunk("agent_message_chunk", "new"),
    )
    put(tmp_path / "%2Fw/S/subagents/K/meta.json", {"status": "ok", "child_session_id": "K"})
    put(tmp_path / "%2Fw/S/subagents/L/meta.json", {"status": "lost"})
    put(tmp_path / "%2Fw/T/updates.jsonl", {**chunk("user_message_chunk", "ask")}, {**chunk("agent_message_chunk", "told")})
    put(tmp_path / "%2Fw/T/summary.json", {"info": {"id": "T-1", "cwd": "/real"}, "generated_title": "made", "created_at": "2023-12-31T00:00:00Z", "last_active_at": "2024-02-01T00:00:00Z", "session_kind": "main", "agent_name": "g", "current_model_id": "m9"})
    every = ingest.ingest_update_streams(spark, str(tmp_path))
    told = every.conversations.filter("thread_id = 'T-1'").first()
    assert (told.title, told.created_at, told.updated_at, told.model_id) == ("made", "2023-12-31T00:00:00Z", "2024-02-01T00:00:00Z", "m9")
    t = every.threads.filter("id = 'T-1'").first()
    assert (t.cwd, t.agent_role, t.agent_nickname) == ("/real", "main", "g") and every.blocks.filter("conversation_id = 'T-1'").count() == 2
    mine = lambda df, c="conversation_id": df.filter(F.col(c) == "S")
    got = ingest.Ingested(every.conversations, mine(every.blocks), mine(every.threads, "id"), every.edges, None, mine(every.census))
    assert shown(got.blocks) == [(0, "human", 0, "text", "do it"), (1, "assistant", 0, "text", "sure thing"), (1, "assistant", 1, "tool_use", "ls"), (1, "assistant", 2, "text", "then"), (1, "assistant", 3, "tool_result", ""), (1, "assistant", 4, "text", "new")]
    assert [tuple(r) for r in got.edges.collect()] == [("S", "K", "ok")]
    assert got.threads.first().cwd == "/w"
    assert {r.kind: r.n for r in got.census.collect()} == {"mode_change": 1, "turn_completed": 1, "user_message_chunk": 2, "agent_message_chunk": 4, "tool_call": 1, "tool_call_update": 1}


def test_chatgpt_export(spark, tmp_path):
    def node(i, parent, role, text, t, children=(), **kw):
        return {"message": {"id": i, "author": {"role": role}, "create_time": t, "content": {"content_type": "text", "parts": [text]}, **kw}, "parent": parent, "children": list(children)}

    tree = {"r": {"message": None, "parent": None, "children": ["u"]}, "u": node("u", "r", "user", "q", 10, ["a", "b"]), "a": node("a", "u", "assistant", "old", 11), "b": node("b", "u", "assistant", "new", 12, ["c"]), "c": node("c", "b", "tool", "more", 13), "h": node("h", "c", "system", "secret", 14)}
    put(tmp_path / "conversations.json", [{"id": "A", "title": "t", "create_time": 10, "current_node": "h", "mapping": tree}, {"id": "B", "current_node": "gone", "mapping": tree}])
    got = ingest.ingest_chatgpt_export(spark, str(tmp_path))
    want = [(0, "human", 0, "text", "q"), (1, "assistant", 0, "text", "new"), (1, "assistant", 1, "text", "more")]
    assert shown(got.blocks.filter("conversation_id = 'A'")) == want
    assert {(r.conversation_id, r.title, r.created_at) for r in got.conversations.collect()} == {("A", "t", "1970-01-01T00:00:10Z"), ("B", "(untitled)", "")}


def test_claude_export(spark, tmp_path):
    m = lambda u, p, t, text="x": {"uuid": u, "parent_message_uuid": p, "sender": "human" if u[0] == "h" else "assistant", "created_at": t, "content": [{"type": "text", "text": text, "citations": [{"title": "T", "url": "http://x"}]}]}
    put(tmp_path / "conversations.json", [{"uuid": "C", "name": "n", "account": {"uuid": "acc"}, "chat_messages": [m("h1", None, "1"), m("a1", "h1", "2"), m("a2", "h1", "3"), m("h2", "a1", "9"), m("z1", "z2", "4"), m("z2", "z1", "5")]}])
    got = ingest.ingest_claude_export(spark, str(tmp_path))
    rows = got.blocks.orderBy("turn_idx").collect()
    assert [r.uuid for r in rows] == ["h1", "a1", "h2", "z1", "z2"]
    assert [tuple(r.branch) if r.branch else None for r in rows] == [None, (1, 2), None, None, None]
    assert rows[0].citations[0].url == "http://x" and got.conversations.first().account == "acc"


def test_design_and_task_exports(spark, tmp_path):
    put(tmp_path / "d/chat.json", {"id": "D", "title": "t", "messages": [{"role": "user", "content": "plain"}, {"role": "assistant", "content": {"blocks": [{"type": "text", "text": "b"}, {"type": "tool_call", "name": "draw", "input": "i", "output": "o"}]}}]})
    assert shown(ingest.ingest_design_chats(spark, str(tmp_path / "d")).blocks) == [(0, "human", 0, "text", "plain"), (1, "assistant", 0, "text", "b"), (1, "assistant", 1, "tool_use", "draw"), (1, "assistant", 2, "tool_result", "")]
    put(tmp_path / "t/codex.json", [{"id": "K", "title": "t", "turns": [{"role": "user", "input_items": [{"type": "message", "content": [{"content_type": "text", "text": "go"}]}]}, {"role": "assistant", "turn_status": "FAILED", "output_items": []}]}])
    assert shown(ingest.ingest_task_export(spark, str(tmp_path / "t")).blocks) == [(0, "human", 0, "text", "go"), (1, "assistant", 0, "tool_result", "")]


def test_activity_log_and_grouping(spark):
    rec = "doc string, pos int, ts string, verb string, title string, detail string, prompt string, response string, gem string"
    df = spark.createDataFrame([("g", 0, "", "Prompted", "", "", "hi", "ho", None), ("g", 1, "2", "Used", "canvas", "", "", "", "x"), ("g", 2, "3", "", "ask", "", "", "yes", "x")], rec)
    assert [(r.turn_idx, r.role, r.type, r.text) for r in ingest.activity_turns(df).orderBy("turn_idx").collect()] == [(0, "human", "text", "hi"), (1, "assistant", "text", "ho"), (2, "assistant", "event", "canvas"), (3, "human", "text", "ask"), (4, "assistant", "text", "yes")]
    assert tuple(ingest.activity_conversations(df).first()) == ("g", "2", "3", ["x"])
    m = 60_000
    gaps = spark.createDataFrame([(0, 0, None), (1, 30 * m, None), (2, None, None), (3, 61 * m, None), (4, 62 * m, "x")], "pos int, ts_ms long, gem string")
    assert [r.grp for r in ingest.group_by_gap(gaps).orderBy("pos").collect()] == ["grp001", "grp001", "grp001", "grp002", "grp003"]
    recs = spark.createDataFrame([(0, "Hi there"), (1, "hi  there "), (2, "other")], "pos int, prompt string")
    harvest = spark.createDataFrame([("A", 0, "hi there"), ("B", 0, "HI THERE"), ("B", 1, "missing")], "id string, turn int, text string")
    out, matched = ingest.group_by_harvest(recs, harvest)
    assert [r.grp for r in out.orderBy("pos").collect()] == ["A", "B", "unmatched"] and matched.first().matched == 2


def test_admission_and_shards(spark):
    docs = spark.createDataFrame([("i", "one", 0, "/a"), ("i", "two", 1, "/b"), (" ", "two", 1, "/x/f.json"), ("k", "two", 1, "/b")], "conversation_id string, source string, priority int, path string")
    edges = spark.createDataFrame([("two", "p", "i"), ("one", "p", "i"), ("two", "p", "k")], "source string, parent string, child string")
    ok, errors, kept = ingest.admit_documents(docs, edges)
    assert sorted((r.conversation_id, r.source) for r in ok.collect()) == [("i", "one"), ("k", "two"), ("unidentified:f.json", "two")]
    assert [tuple(r) for r in errors.collect()] == [("i", "two", "id belongs to one")]
    assert sorted((r.source, r.child) for r in kept.collect()) == [("one", "i"), ("two", "k")]
    shards = spark.createDataFrame([("i", "a", 0, None), ("i", "b", 0, "P"), ("", "a", 1, None), ("", "a", 2, None)], "conversation_id string, path string, pos int, project string")
    first, repeats = ingest.dedup_across_shards(shards)
    assert sorted((r.conversation_id, r.path, r.project) for r in first.collect() if r.conversation_id) == [("i", "a", "P")] and first.count() == 3
    assert [tuple(r) for r in repeats.collect()] == [("b", 1)]


def test_resumed_legs(spark):
    t = spark.createDataFrame(
        [("c", 0, 0, "u1", "human", "1", "a"), ("c", 0, 1, "u2", "assistant", "2", "bb"), ("c", 1, 0, "u1", "human", "1", "a"), ("c", 1, 1, "u2", "assistant", "2", "bbbb"), ("c", 1, 2, "", "human", "3", "new"), ("c", 2, 0, "", "human", "3", "new"), ("c", 2, 1, "u2", "assistant", "2", "bbb")],
        "conversation_id string, leg int, turn_idx int, uuid string, role string, ts string, text string",
    )
    merged, divergent = ingest.fold_resumed_legs(t)
    assert [(r.turn_idx, r.text) for r in merged.orderBy("turn_idx").collect()] == [(0, "a"), (1, "bbbb"), (2, "new")]
    assert divergent.first().divergent == 1
    heads = spark.createDataFrame([("c", 0, "first", "/0", "5", 3), ("c", 1, "second", "/1", "4", 9)], "conversation_id string, leg int, title string, path string, updated_at string, tokens_used int")
    assert tuple(ingest.fold_leg_heads(heads).first()) == ("c", "first", "/1", "5", 9, ["/0", "/1"])


def test_state_graph_and_merge(spark):
    t = spark.createDataFrame([("a", None, 5), ("b", "T", 9), (None, "x", 1)], "id string, title string, updated_at int")
    e = spark.createDataFrame([("a", "b"), ("", "b")], "parent_thread_id string, child_thread_id string")
    threads, edges = ingest.ingest_state_graph(t, e)
    assert [(r.id, r.title, r.tokens_used) for r in threads.collect()] == [("b", "T", 0), ("a", "", 0)] and edges.count() == 1
    assert ingest.ingest_state_graph(t.drop("id"))[0].count() == 0
    other = threads.withColumn("title", F.lit("late")).unionByName(threads.filter("id = 'a'").withColumn("id", F.lit("z")))
    merged, edges2 = ingest.merge_graph([(threads, edges), (other, edges.withColumn("status", F.lit("late")))])
    assert {r.id: r.title for r in merged.collect()} == {"a": "", "b": "T", "z": ""}
    assert [r.status for r in edges2.collect()] == [""]


def test_export_files_and_inventory(spark):
    l = spark.createDataFrame([("s1", "/a/conversations.json"), ("s1", "/a/users.json"), ("s2", "/b/renamed.json"), ("s3", "/c/readme.txt")], "source string, path string")  # noqa: E741
    files, errors = ingest.resolve_export_files(l, r"^conversations(-.*)?\.json$")
    assert sorted(r.path for r in files.collect()) == ["/a/conversations.json", "/b/renamed.json"]
    assert [r.source for r in errors.collect()] == ["s3"]
    listing = [("/h/.codex/sessions/2024/rollout-1.jsonl", 1, 5), ("/h/.codex/sessions/2024/rollout-2.jsonl.zst", 1, 7), ("/d/conversations.json", 1, 1), ("/d/chat.html", 1, 1), ("/e/conversations.json", 1, 2), ("/h/.claude/projects/p/s.jsonl", 1, 1), ("/t/Takeout/transcript.json", 1, 1)]
    got = {(r.provider, r.path): r for r in ingest.source_inventory(spark.createDataFrame(listing, "path string, bytes long, mtime long")).collect()}
    assert got[("codex", "/h/.codex/sessions")]["count"] == 2 and got[("codex", "/h/.codex/sessions")].newest == 7
    assert got[("chatgpt", "/d/conversations.json")].confidence == "high"
    assert got[("chatgpt|claude", "/e/conversations.json")].ambiguous
    assert got[("gemini", "/t/Takeout/transcript.json")].confidence == "medium" and ("claude-code", "/h/.claude/projects") in got


def test_incremental_ingest_resumes_and_replays(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "conversation_id string, body string"

    def parse(df):
        return df.select("path", F.get_json_object("value", "$.id").alias("conversation_id"), F.get_json_object("value", "$.body").alias("body"))

    def run():
        incremental.incremental_ingest(spark, str(src), out, parse, schema, ["conversation_id"]).awaitTermination()
        return {r.conversation_id: r.body for r in incremental.read_table(spark, f"{out}/rows", schema).collect()}

    put(src / "a.jsonl", {"id": "a", "body": "1"})
    put(src / "bad.jsonl", text="not json")
    assert run() == {"a": "1"}
    put(src / "a2.jsonl", {"id": "a", "body": "grown"})
    put(src / "same.jsonl", {"id": "a", "body": "1"})  # content seen before: skipped
    assert run() == {"a": "grown"}
    assert run() == {"a": "grown"}
    files = {r.path.rsplit("/", 1)[1]: r.error for r in incremental.read_table(spark, f"{out}/files", incremental.FILES).collect()}
    assert files["bad.jsonl"] == "unreadable" and files["a2.jsonl"] is None


def test_incremental_ingest_writes_changed_parts_only(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "conversation_id string, body string"

    def parse(df):
        return df.select("path", F.get_json_object("value", "$.id").alias("conversation_id"), F.get_json_object("value", "$.body").alias("body"))

    def run():
        incremental.incremental_ingest(spark, str(src), out, parse, schema, ["conversation_id"]).awaitTermination()
        return {r.conversation_id: r.body for r in incremental.read_table(spark, f"{out}/rows", schema).collect()}

    parts = lambda v: {p.name for p in (tmp_path / f"out/rows/v={v}").glob("part=*")}
    for i in range(40):
        put(src / f"f{i}.jsonl", {"id": f"c{i}", "body": "1"})
    put(src / "twin.jsonl", {"id": "c1", "body": "1"})  # equal content in one batch: recorded too
    put(src / "z.jsonl", {"id": "c2", "body": "last path"})
    want = {f"c{i}": "1" for i in range(40)} | {"c2": "last path"}
    assert run() == want
    names = [r.path.rsplit("/", 1)[1] for r in incremental.read_table(spark, f"{out}/files", incremental.FILES).collect()]
    assert len(names) == 42 and "twin.jsonl" in names
    put(src / "new.jsonl", {"id": "c3", "body": "2"})
    want["c3"] = "2"
    assert run() == want
    assert len(parts(1)) == 1 < len(parts(0))
    (tmp_path / "out/rows/v=1/_SUCCESS").rename(tmp_path / "out/rows/v=1/gone")  # a version that is not whole doesn't count
    assert {r.body for r in incremental.read_table(spark, f"{out}/rows", schema).collect()} == {"1", "last path"}
    (tmp_path / "out/rows/v=1/gone").rename(tmp_path / "out/rows/v=1/_SUCCESS")
    monkeypatch.setattr(incremental, "MAX_VERSIONS", 2)
    put(src / "more.jsonl", {"id": "c3", "body": "3"})
    want["c3"] = "3"
    assert run() == want
    assert parts(2) == parts(0)


