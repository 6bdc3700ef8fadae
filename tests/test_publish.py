"""Versions that readers see only whole, segments of an index, digests, surfaces and names of hidden characters."""

import random
import unicodedata

from pyspark.sql import functions as F

from threadloom.operators import export, graph, index, privacy, search, segments
from threadloom.sources import versions


def graph_of(spark, n, rename=()):
    t = spark.createDataFrame([(f"t{i}", "new" if i in rename else None if i % 5 == 0 else f"title {i}", i) for i in range(n)], "id string, title string, tokens_used long")
    e = spark.createDataFrame([(f"t{i // 2}", f"t{i}", "s") for i in range(1, n)], "parent string, child string, status string")
    return t, e


def test_diff_by_digests_equals_the_diff(spark):
    old, new = graph_of(spark, 60), graph_of(spark, 62, {5, 17})
    new = new[0].filter("id <> 't40'"), new[1].filter("child <> 't40'").unionByName(new[1].limit(3))
    rows = lambda **how: sorted((tuple(r) for r in graph.diff(old, new, ["title", "tokens_used"], **how).collect()), key=str)
    assert rows() == rows(buckets=7) == rows(buckets=1000) and len(rows()) > 5
    assert graph.diff(old, old, ["title"], buckets=64).count() == 0
    left, right = graph.unequal(old[0], new[0], ["id"], ["id", "title"], 1000)
    assert left.count() < 10 and right.count() < 10


def test_a_failed_gate_leaves_what_was_published(spark, tmp_path):
    root = str(tmp_path / "out")
    n, e = graph_of(spark, 8)
    gate = lambda *oks: spark.createDataFrame([(f"c{i}", ok) for i, ok in enumerate(oks)], "conversation_id string, ok boolean")
    assert export.read_published(spark, root, n, e) is None
    first = export.publish_graph(n, e, root, "full", gate(True, True))
    assert first["ok"] and export.read_published(spark, root, n, e)[0].count() == 8
    second = export.publish_graph(n.limit(3), e.limit(0), root, "full", gate(True, False), n.limit(2))
    assert (second["ok"], second["pages_failed"], second["findings"], second["graph_ok"]) == (False, 1, 2, True)
    assert export.read_published(spark, root, n, e)[0].count() == 8 and not (tmp_path / "out" / second["version"]).exists()
    (tmp_path / "out/manifests/000000009").mkdir()  # a manifest that was begun and never finished
    assert export.read_published(spark, root, n, e)[0].count() == 8 and versions.newest(spark, root) == first["version"]


def test_segments_answer_like_a_new_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 3)
    rng, path = random.Random(1), str(tmp_path / "ix")
    words = "red green blue sun moon star".split()
    state = {f"c{i}": " ".join(rng.choice(words) for _ in range(6)) for i in range(12)}

    def made(texts):
        c = spark.createDataFrame([(k, "", "p", "a", "") for k in texts] or [("", "", "", "", "")], "conversation_id string, title string, provider string, account string, created_at string").filter("conversation_id <> ''")
        b = spark.createDataFrame([(k, 0, 0, "human", "text", v) for k, v in texts.items()] or [("", 0, 0, "", "", "")], "conversation_id string, turn_idx int, block_idx int, role string, type string, text string").filter("conversation_id <> ''")
        return index.build_conversation_index(c, b)

    segments.create_index(made(state), path, 2)
    for step in range(4):
        changed = {f"c{rng.randrange(16)}": " ".join(rng.choice(words) for _ in range(6)) for _ in range(3)}
        deleted = rng.sample(sorted(state), 1)
        segments.upsert_index(made(changed), path, spark.createDataFrame([(k,) for k in deleted], "conversation_id string"), 2)
        state = {k: v for k, v in {**state, **changed}.items() if k not in deleted}
        assert len(segments._segments(spark, path)) == (1 if step == 2 else 2 if step == 3 else step + 2)
    fresh = str(tmp_path / "fresh")
    search.store_index(made(state), fresh, 2)
    for text in ("red", "sun moon", '"red sun"', "gr* blue"):
        a, b = (sorted((r.conversation_id, round(r.bm25, 9), r.total) for r in search.search(*ix, text).collect()) for ix in (segments.open_segments(spark, path), search.open_index(spark, fresh)))
        assert a == b and (a or text != "red")


def test_surfaces_and_names(spark):
    c = spark.createDataFrame([("c", "t", None)], "conversation_id string, title string, account string")
    b = spark.createDataFrame([("c", "x", '{"name":"n","input":{"k":["v"]},"content":"o","other":"no"}', [("ct", None)]), ("c", "", "not json", None)], "conversation_id string, text string, data string, citations array<struct<title:string,url:string>>")
    assert sorted((r.surface, r.text) for r in privacy.text_surfaces(c, b).collect()) == [("citation", "ct"), ("content", "o"), ("input", '{"k":["v"]}'), ("name", "n"), ("text", "x"), ("title", "t")]
    chars = "​­‮︀\U000e0041\U000e0100ᅟ\x07"
    df = spark.createDataFrame([(ch, unicodedata.name(ch, "unnamed")) for ch in chars], "ch string, want string")
    got = df.select("want", privacy.neutralize_text(F.col("ch"), "badge").alias("b")).collect()
    assert all(f'title="{r.want} (hidden)"' in r.b for r in got)
