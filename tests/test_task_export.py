"""Turns of a task export: status, standing instructions, pull requests, snapshots, provenance."""

import json

from threadloom.sources import ingest


def read(spark, tmp_path, turns, **thread):
    (tmp_path / "codex.json").write_text(json.dumps([{"id": "K", "title": "t", "turns": turns, **thread}]))
    got = ingest.ingest_task_export(spark, str(tmp_path))
    return [(r.turn_idx, r.role, r.type, r.text, json.loads(r.data) if r.data else None) for r in got.blocks.orderBy("turn_idx", "block_idx").collect()], got


def test_status_is_cut_at_the_dot(spark, tmp_path):
    turn = lambda status: {"role": "assistant", "id": status, "turn_status": status, "branch": "b1", "output_items": [{"type": "message", "content": [{"content_type": "text", "text": "said"}]}]}
    rows, got = read(spark, tmp_path, [turn("TaskTurnStatusEnum.COMPLETED"), turn("TaskTurnStatusEnum.FAILED"), turn("IN_PROGRESS"), turn("COMPLETED"), {"role": "assistant", "turn_status": "E.CANCELLED", "output_items": []}], archived=True)
    assert [r[:4] for r in rows] == [(0, "assistant", "text", "said"), (1, "assistant", "tool_result", ""), (1, "assistant", "text", "said"), (2, "assistant", "tool_result", ""), (2, "assistant", "text", "said"), (3, "assistant", "text", "said"), (4, "assistant", "tool_result", "")]
    state = [r[4] for r in rows if r[2] == "tool_result"]
    assert [(s["name"], s["is_error"]) for s in state] == [("task FAILED", True), ("task IN_PROGRESS", False), ("task CANCELLED", False)]
    assert state[0]["content"] == {"id": "TaskTurnStatusEnum.FAILED", "turn_status": "FAILED", "pull_request_status": "", "branch": "b1", "branch_name": "", "previous_turn_id": "", "external_pull_request_id": ""}
    census = got.census.orderBy("turn_idx").collect()
    assert [(r.turn_status, r.branch, r.archived) for r in census] == [("COMPLETED", "b1", True), ("FAILED", "b1", True), ("IN_PROGRESS", "b1", True), ("COMPLETED", "b1", True), ("CANCELLED", "", True)]


def test_what_users_hand_in(spark, tmp_path):
    info = {"type": "pull_request_info", "title": "T", "body": " ", "base_ref": "main", "head_ref": None}
    rows, _ = read(spark, tmp_path, [{"role": "user", "custom_instructions": "be brief", "input_items": [{"type": "message", "content": [{"content_type": "text", "text": "go"}]}, info, {"type": "ide_context", "context": "c"}, "no item"]}, {"role": "user", "custom_instructions": " ", "input_items": None}])
    assert [r[2:4] for r in rows] == [("unknown", ""), ("text", "go"), ("text", "T"), ("tool_use", ""), ("unknown", ""), ("text", "")]
    assert rows[0][4] == {"orig_type": "custom_instructions", "x_raw": "be brief"}
    assert rows[3][4] == {"name": "pull_request_info", "input": {"base_ref": "main", "head_ref": None, "merge_commit_sha": None}}
    assert rows[4][4]["orig_type"] == "ide_context" and json.loads(rows[4][4]["x_raw"]) == {"type": "ide_context", "context": "c"}


def test_pull_requests(spark, tmp_path):
    pr = lambda diff: {"type": "pr", "pr_title": "P", "pr_message": "M", "pre_apply_patch": None, "output_diff": diff}
    here = {"commit_message": "C", "diff": "+a", "files_modified": 2, "repo_id": "r", "additional_parent_commit_shas": []}
    away = {"commit_message": "", "diff": None, "external_storage_diff": {"file_id": "F", "ttl": None}}
    rows, _ = read(spark, tmp_path, [{"role": "assistant", "turn_status": "COMPLETED", "pull_request_status": "created", "branch_name": None, "output_items": [pr(here), pr(away), pr(None)]}])
    assert [r[2:4] for r in rows] == [
        ("text", "P"), ("text", "M"), ("text", "C"), ("code", "+a"), ("tool_use", ""), ("tool_use", ""),
        ("text", "P"), ("text", "M"), ("file", "diff (external storage)"), ("tool_use", ""), ("tool_use", ""),
        ("text", "P"), ("text", "M"), ("unknown", ""), ("tool_use", ""),
    ]
    assert rows[3][4] == {"language": "diff"} and rows[8][4] == {"file_name": "diff (external storage: file_id=F, ttl=None)"}
    stats = rows[4][4]
    assert stats["name"] == "pr_diff_stats" and stats["input"]["files_modified"] == 2 and stats["input"]["additional_parent_commit_shas"] == [] and stats["input"]["lines_added"] is None and len(stats["input"]) == 8
    assert rows[5][4] == {"name": "pull_request", "input": {"pull_request_status": "created", "external_pull_request_id": "", "branch": "", "branch_name": "", "previous_turn_id": ""}}


def test_snapshots(spark, tmp_path):
    files = [
        {"path": "src/a.tar.gz", "contents": None, "line_range_contents": [{"line_range_start": 1, "line_range_end": 2, "contains_end_of_file": False, "content": ["x", "y"]}, {"line_range_start": 9, "line_range_end": None, "content": "z"}]},
        {"path": ".env", "contents": "whole", "line_range_contents": None},
        {"path": "gone", "missing_reason": "too big"},
    ]
    rows, _ = read(spark, tmp_path, [{"role": "assistant", "turn_status": "COMPLETED", "output_items": [{"type": "partial_repo_snapshot", "files": files}, {"type": "partial_repo_snapshot"}, {"type": "later", "z": 1}]}])
    assert [r[2:4] for r in rows] == [("attachment", "src/a.tar.gz"), ("attachment", ".env"), ("tool_result", ""), ("unknown", "")]
    assert rows[0][4] == {
        "file_name": "src/a.tar.gz", "file_type": "gz", "file_size": 20, "extracted_content": "L1-L2\nx\ny\nL9-LNone\nz",
        "ranges": [{"line_range_start": 1, "line_range_end": 2, "contains_end_of_file": False}, {"line_range_start": 9, "line_range_end": None, "contains_end_of_file": False}],
    }
    assert (rows[1][4]["file_type"], rows[1][4]["extracted_content"], rows[1][4]["ranges"]) == ("", "whole", [])
    assert rows[2][4] == {"name": "repo_snapshot gone", "is_error": True, "content": "too big"}
