"""Sources written by the queries: a fixed number of files, however many conversations they hold."""

from threadloom.plans import queries
from threadloom.sources import ingest


def files_of(spark, path):
    return spark.read.option("recursiveFileLookup", "true").text(path).select("_metadata.file_path").distinct().count()


def test_exports_hold_many_conversations_a_file(spark):
    docs = spark.range(100).selectExpr("id as conv_id", """concat('{"uuid":"k', id, '","chat_messages":[{"uuid":"n","sender":"human","content":[{"type":"text","text":"a } ] b', id, '"}]}]}') as value""")
    path = queries._exported(docs, "packed")
    assert files_of(spark, path) == queries.EXPORT_FILES
    found = {(r.conversation_id, r.text) for r in ingest.ingest_claude_export(spark, path, "*.txt").blocks.collect()}
    assert found == {(f"k{i}", f"a }} ] b{i}") for i in range(100)}


def test_rollouts_fold_from_lines_of_one_file(spark):
    said = lambda n, role: f'{{"type":"response_item","payload":{{"type":"message","role":"{role}","content":[{{"type":"input_text","text":"x{n}"}}]}}}}'
    rows = [(f"s{f}", 10 * f + i, said(i, role)) for f in range(3) for i, role in enumerate(("user", "assistant", "user"))]
    rows += [(f"s{f}", 10 * f - 1, f'{{"type":"session_meta","payload":{{"id":"id{f}"}}}}') for f in range(3)]
    blocks = ingest.fold_rollouts(spark.createDataFrame(rows, "path string, line long, json string")).blocks
    assert {(r.conversation_id, r.turn_idx, r.text) for r in blocks.collect()} == {(f"id{f}", i, f"x{i}") for f in range(3) for i in range(3)}


def test_live_path_of_rows_without_messages():
    assert ingest._live_path(None) == []
    row = lambda u, p, t: {"uuid": u, "parent": p, "ts": t}
    assert ingest._live_path([row("a", None, "1"), row("x", "a", "2"), row("b", "a", "3")]) == [("a", 0, None, None), ("b", 1, 2, 2)]


def test_messages_are_placed_in_their_conversations_row(spark):
    said = lambda uuid, up, ts: f'{{"uuid":"{uuid}","parent_message_uuid":"{up}","sender":"human","created_at":"{ts}","content":[{{"type":"text","text":"t{uuid}{ts}"}}]}}'
    chat = ",".join([said("b", "a", 3), said("a", "", 1), said("x", "a", 2), said("a", "", 1), '{"sender":"human","created_at":"4","content":[{"type":"text","text":"nameless"}]}'])
    docs = spark.createDataFrame([(i, f'{{"uuid":"k{i}","chat_messages":[{chat}]}}') for i in range(3)], "conv_id long, value string")
    blocks = ingest.ingest_claude_export(spark, queries._exported(docs, "placed"), "*.txt").blocks
    assert "Join" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r.conversation_id, r.turn_idx, r.uuid, r.text, r.branch and (r.branch["index"], r.branch["total"])) for r in blocks.collect())
    # two messages of one name share its place; one without a name has none
    assert found == [(f"k{i}", *m) for i in range(3) for m in ((0, "a", "ta1", (1, 2)), (0, "a", "ta1", (1, 2)), (1, "b", "tb3", (2, 2)))]
