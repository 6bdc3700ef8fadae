"""Search by blocks against search over all postings: the same pages, and how little of them is scored."""

import random

import pytest

from threadloom.operators import block_max, search


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Documents of very different lengths; every word anywhere, some rare; zed once in many and often in eight."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["tax", "taxi", "taxed"]
    rows = []
    for i in range(1200):
        n = rng.choice((3, 8, 20, 60, 150))
        text = " ".join(rng.choice(vocab[: rng.choice((5, 30, 63))]) for _ in range(n))
        text += " zed" * (12 if i % 150 == 7 else 1 if i % 3 == 0 else 0)
        rows.append((f"c{i:04d}", text if i % 100 else "", rng.choice("pq"), "", f"202{i % 4}-01-0{i % 7 + 1}T00:00:00Z" if i % 9 else ""))
    rows += [(f"d{i}", "w0 w1 tax", "p", "", "") for i in range(40)]  # ties
    ix = spark.createDataFrame([(c, f"title {c}", p, t, at, body) for c, body, p, t, at in rows], "conversation_id string, title string, provider string, thread_id string, created_at string, body string")
    path = str(tmp_path_factory.mktemp("index"))
    search.store_index(ix, path, 4)
    block_max.store_blocks(spark, path, block_docs=32, partitions=4)
    return path


QUERIES = [
    ("w0", {}), ("w40 w41", {"limit": 7}), ("zed", {"limit": 5}), ("zed w3", {"limit": 6}), ("tax*", {"limit": 10, "offset": 20}), ("w1 tax* w2", {"limit": 5}), ("tax tax*", {}), ("nothing", {}), ("w3 nothing", {}), ("!!", {}),
    ("w0 w1", {"limit": 9, "provider": "q"}), ("w0 w1", {"since": "2021", "until": "2022", "limit": 4, "offset": 3}), ("w0", {"limit": 5, "offset": 100_000}), ('"w0 w1"', {"limit": 5}), ("title", {"limit": 3}),
]


@pytest.mark.parametrize("text,how", QUERIES)
def test_pages_equal_search(spark, stored, text, how):
    rows = lambda df: [(r.conversation_id, r.snippet, round(r.score, 9), r.provider, r.thread_id, r.ts_ms, round(r.bm25, 9), r.total) for r in df.collect()]
    want = rows(search.search(*search.open_index(spark, stored), text, **how))
    assert rows(block_max.search_blocks(spark, stored, text, **how)) == want


@pytest.mark.parametrize("text", ["zed", "zed zed*"])
def test_few_documents_are_scored(spark, stored, text):
    lists, size = spark.read.parquet(f"{stored}/blocks"), tuple(spark.read.parquet(f"{stored}/size").first())
    scores, blocks, total = block_max.page_blocks(lists, size, search.parse_query(text), 5)
    assert total > 350 and 5 <= scores.count() < total / 2
    assert blocks.filter("not scored").count() > blocks.filter("scored").count()


def test_no_documents(spark, tmp_path):
    ix = spark.createDataFrame([], "conversation_id string, title string, provider string, thread_id string, created_at string, body string")
    search.store_index(ix, str(tmp_path), 2)
    block_max.store_blocks(spark, str(tmp_path), partitions=2)
    assert block_max.search_blocks(spark, str(tmp_path), "any word").count() == 0
