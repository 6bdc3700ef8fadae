"""Files that many tasks read: tiny splits and short stretches must give the rows of one task."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources import ingest, jsonl, lines

SPLITS = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}


@pytest.fixture
def tiny(spark, monkeypatch):
    """Splits of a few lines and stretches of three."""
    was = {k: spark.conf.get(k, None) for k in SPLITS}

    def on():
        for k, v in SPLITS.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(lines, "STRETCH", 3)

    yield on
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_line_numbers_over_splits(spark, tmp_path, tiny):
    rng = random.Random(1)
    for name in "ab":
        text = "\n".join(rng.choice(["", "nope", "[1]", json.dumps({"k": i, "t": "x" * rng.randint(0, 90)})]) for i in range(120))
        (tmp_path / f"{name}.jsonl").write_text(text + ("\n" if name == "a" else ""))
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "d.jsonl").write_bytes(b'{"k": 1}\r\n\r\n{"k": 2}\r\n')
    read = lambda: [rows(x, "path", "line") for x in jsonl.read_json_lines(spark, str(tmp_path))]
    whole = read()
    tiny()
    assert lines.numbered_lines(spark, str(tmp_path), "a.jsonl").rdd.getNumPartitions() > 10
    assert read() == whole
    want = []
    for name in "ab":
        for i, s in enumerate((tmp_path / f"{name}.jsonl").read_text().split("\n"), 1):
            if s.startswith("{"):
                want.append((name, i, json.loads(s)["k"]))
    got = [(p.rsplit("/", 1)[1][0], i, json.loads(j)["k"]) for p, i, j in whole[0]]
    assert got == want + [("d", 1, 1), ("d", 3, 2)]
    assert {(r[2], r[0].rsplit("/", 1)[1][0]) for r in whole[1]} == {("invalid JSON", "a"), ("invalid JSON", "b"), ("not an object", "a"), ("not an object", "b")}


def test_running_figures_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(lines, "STRETCH", 4)
    rng = random.Random(2)
    given = [(d, n, rng.choice([None, rng.randint(-5, 9)])) for d in "pq" for n in sorted(rng.sample(range(60), 30))]
    df = spark.createDataFrame(given, "d string, line long, v long")
    for how, f in (("sum", sum), ("max", max), ("last", lambda x: x[-1])):
        for before in (False, True):
            want = []
            for d, n, v in given:
                seen = [w for e, m, w in given if e == d and w is not None and (m < n or (m == n and not before))]
                want.append((d, n, v, f(seen) if seen else None))
            assert rows(lines.carried(df, "x", how, F.col("v"), "d", before=before), "d", "line") == want


def test_turns_and_runs_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(lines, "STRETCH", 5)
    rng = random.Random(3)
    given = [("d", i, rng.random() < 0.2, rng.randint(1, 3)) for i in range(100)] + [("e", 7, False, 2), ("f", 9, True, 1)]
    got = {(r[0], r[1]): r[2:] for r in rows(lines.number_turns(spark.createDataFrame(given, "d string, line long, user boolean, parts int"), "d"), "d", "line")}
    turn, at, prior, doc = -1, 0, None, None
    for d, n, user, parts in given:
        if d != doc:
            turn, prior, doc = -1, None, d
        if user or prior is None or prior:
            turn, at = turn + 1, 0
        assert got[d, n] == (turn, at)
        at, prior = at + parts, user
    kinds = [("d", i, rng.choice("ab")) for i in range(60)]
    got = [r[2] for r in rows(lines.number_runs(spark.createDataFrame(kinds, "d string, line long, g string"), "g", "d"), "line")]
    assert got == [1 + sum(kinds[j][2] != kinds[j - 1][2] for j in range(1, i + 1)) for i in range(60)]


def test_rollout_of_many_tasks(spark, tmp_path, tiny):
    rng = random.Random(4)
    say = lambda i, role: {"type": "response_item", "timestamp": f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": f"{i}{c}"} for c in "ab"[: rng.randint(1, 2)]]}}
    (tmp_path / "rollout-1.jsonl").write_text("\n".join(json.dumps(say(i, rng.choice(["user", "assistant", "assistant"]))) for i in range(90)))
    read = lambda: rows(ingest.ingest_rollouts(spark, str(tmp_path)).blocks, "turn_idx", "block_idx")
    whole = read()
    tiny()
    assert read() == whole and len({r[1] for r in whole}) > 20
    # the blocks of a turn are numbered without gaps, and texts stay in the order of the file
    assert [r[3] for r in whole] == [i for t in range(max(r[1] for r in whole) + 1) for i in range(sum(r[1] == t for r in whole))]
    assert [int(r[5][:-1]) for r in whole] == sorted(int(r[5][:-1]) for r in whole)


TRICKY = [
    {"id": "x}y", "t": 'a "quoted} [text', "deep": {"a": [{"b": "}"}, {}]}},
    7, None, "plain }, {", [1, {"c": "]"}], {}, {"e": "\\"}, {"f": "\\\"}"}, [[], {"g": {}}], {"u": "é}ü“]"}, True, [],
]


@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_over_splits(spark, tmp_path, tiny, indent):
    rng = random.Random(5)
    many = [rng.choice(TRICKY) for _ in range(150)]
    write = lambda name, data, before="": (tmp_path / name).write_text(before + json.dumps(data, indent=indent, ensure_ascii=False))
    write("conversations-many.json", many)
    write("conversations-first.json", TRICKY, "\ufeff \n")
    write("conversations-none.json", [])
    write("conversations-one.json", [5])
    write("conversations-object.json", {"k": {"a": "}"}, "l": [1, 2]})
    (tmp_path / "conversations-empty.json").write_text("")
    (tmp_path / "conversations-line.json").write_text(json.dumps({"z": {}}) + "\n")
    read = lambda: [(p.rsplit("-", 1)[1], n, json.loads(j)) for p, n, j in rows(ingest.export_records(spark, str(tmp_path), "conversations*.json"), "path", "pos")]
    want = [("first.json", i, e) for i, e in enumerate(TRICKY)] + [("line.json", 0, {"z": {}})] + [("many.json", i, e) for i, e in enumerate(many)] + [("object.json", 0, {"k": {"a": "}"}, "l": [1, 2]}), ("one.json", 0, 5)]
    assert read() == want
    tiny()
    assert read() == want


def test_bad_elements_leave_the_rest(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"b": nonsense}, {"c": 3}]')
    assert [json.loads(r.json) for r in ingest.export_records(spark, str(tmp_path), "x.json").orderBy("pos").collect()] == [{"a": 1}, {"c": 3}]
