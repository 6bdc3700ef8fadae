"""Citations and other parts of a task export's messages."""

import json

from threadloom.sources import ingest


def test_task_export_keeps_every_part(spark, tmp_path):
    cite = lambda path, a, b: {"content_type": "repo_file_citation", "path": path, "line_range_start": a, "line_range_end": b}
    parts = [
        cite("early.py", 1, 2),
        {"content_type": "text", "text": "first"},
        cite("a.py", 3, 9),
        {"content_type": "image_asset_pointer_citation", "asset_pointer": "sediment://x"},
        {"content_type": "terminal_chunk_citation", "terminal_chunk_id": "c7", "line_range_start": 4, "line_range_end": 5},
        {"content_type": "text", "text": "  "},
        {"content_type": "text", "text": "second"},
        {"content_type": "novel", "z": 1},
        cite("b.py", 6, 6),
    ]
    turns = [{"role": "user", "input_items": [{"type": "message", "content": "plain"}]}, {"role": "assistant", "turn_status": "COMPLETED", "output_items": [{"type": "message", "content": parts}]}]
    (tmp_path / "codex.json").write_text(json.dumps([{"id": "K", "title": "t", "turns": turns}]))
    rows = ingest.ingest_task_export(spark, str(tmp_path)).blocks.orderBy("turn_idx", "block_idx").collect()
    assert [(r.type, r.text, [c.title for c in r.citations or []]) for r in rows] == [
        ("text", "plain", []),
        ("file", "early.py:L1-L2", []),
        ("text", "first", ["a.py:L3-L9", "terminal c7:L4-L5"]),
        ("media", "sediment://x", []),
        ("text", "second", ["b.py:L6-L6"]),
        ("unknown", "", []),
    ]
    assert json.loads(json.loads(rows[-1].data)["x_raw"]) == {"content_type": "novel", "z": 1}
