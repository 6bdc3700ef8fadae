"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import byte_words, collocations, lexical_search, vector_search

VOCAB = "red green blue one two three four five six seven eight nine ten sun moon star tree river stone cloud Ünder çok".split()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(rng, n, most=60):
    return [" ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ".", ",\t", " ?"]) for _ in range(rng.randint(1, most))) for _ in range(n)]


def clash(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


# words


def test_words_of_a_batch_are_those_of_each_text():
    rng = random.Random(1)
    made = [None, "", " \t", "A b", "é.É x", *texts(rng, 50), "end", "", None]
    w = byte_words.split_words(pa.array(made, pa.string()).slice(1), collocations.WORDS)
    want = [(i, word, k == 0) for i, t in enumerate(made[1:]) for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(ASCII)) for k, word in enumerate(re.findall("[^ \t]+", piece))]
    distinct = [x.decode() for x in w.distinct.to_pylist()]
    assert [(int(r), distinct[i], bool(o)) for r, i, o in zip(w.row, w.ids, w.opens)] == want


def test_runs_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 95, "c", "", "d" * 30]})
    runs = list(byte_words.text_runs(iter([batch]), 0, size=40))
    assert len(runs) > 1
    assert pa.Table.from_batches(runs).to_pydict() == batch.to_pydict()


# 11


def ranked_by_hand(docs, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(ASCII))) for i, t in docs]
    terms = [(i, x) for i, x in terms if x]
    n_docs, total = len(terms), sum(len(x) for _, x in terms)
    df = Counter(t for _, x in terms for t in set(x))
    out = []
    for item, text in dict.fromkeys(items):
        wanted, found = set(TERM.findall((text or "").translate(ASCII))), []
        for i, x in terms:
            tf, m = Counter(x), 10 + (90 * len(x) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in wanted if t in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found_by_search(spark, docs, items, **how):
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"), "key", "term", "n", "x", "score", "rank", "item_id")
    q = clash(spark.createDataFrame(items, "item_id long, text string"), "doc_id", "weight", "key")
    return sorted((tuple(r) for r in lexical_search.search(d, q, **how).collect()), key=str)


@pytest.mark.parametrize("bits", [22, 4])
def test_search_equals_scoring_everything(spark, monkeypatch, bits):
    # with 16 coordinates nearly all terms collide, so that bounds are loose and thresholds do the work
    rng = random.Random(bits)
    made = texts(rng, 120)
    docs = [(i, t) for i, t in enumerate(made)] + [(200 + i, made[0]) for i in range(60)]
    docs += [(300, None), (301, ""), (302, "..."), (None, "sun moon"), (303, "red"), (303, "red"), (303, "red moon"), (304, "sun " * 70_000)]
    items = [(1, "red sun"), (2, "MOON ünder çok"), (2, "stone"), (3, None), (4, ""), (5, "absent words"), (6, made[0]), (1, "red sun"), (7, "red absent"), (8, "sun sun")]
    index = lexical_search._index
    if bits == 4:
        monkeypatch.setattr(lexical_search, "coordinates", lambda terms: (byte_words.word_hashes(terms) % np.uint64(16)).astype(np.uint32))
        monkeypatch.setattr(lexical_search, "FIRST", 12)
        # the tasks of this session import the module afresh, so the index is made here
        rows = [(t, i, h) for i, t, h in spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text")).collect()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["text", "doc_id", "text_hash"])
        made_index = spark.createDataFrame([tuple(r.values()) for b in index(iter([batch])) for r in b.to_pylist()], lexical_search.INDEX)
        got = found_by_search(spark, docs, items, index=made_index)
    else:
        got = found_by_search(spark, docs, items)
    assert got == ranked_by_hand(docs, items)


def test_search_in_several_batches_and_with_a_stored_index(spark, monkeypatch):
    rng = random.Random(3)
    docs, items = list(enumerate(texts(rng, 80))), [(i, t) for i, t in enumerate(texts(rng, 30, 8))]
    index = lexical_search.sketch_index(spark.createDataFrame(docs, "doc_id long, text string"))
    monkeypatch.setattr(lexical_search, "BATCH_QUERIES", 7)
    assert found_by_search(spark, docs, items, k=3, index=index) == ranked_by_hand(docs, items, 3)


def test_search_in_nothing(spark):
    assert found_by_search(spark, [], [(1, "red")]) == []
    assert found_by_search(spark, [(1, "red")], []) == []
    assert found_by_search(spark, [(1, None)], [(1, "red")]) == []


def test_bounds_are_never_under_the_scores():
    rng = random.Random(4)
    made = texts(rng, 40)
    batch = pa.RecordBatch.from_arrays([pa.array(made), pa.array(range(40), pa.int64()), pa.array([0] * 40, pa.int64())], names=["a", "b", "c"])
    rows = next(iter(lexical_search._index(iter([batch]))))
    terms = [(1, t.translate(ASCII), 700 + 13 * i) for i, t in enumerate(VOCAB)]
    q = lexical_search.query_batch(terms, {})
    coords, most = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column(3)], [np.frombuffer(x.as_buffer(), np.uint16) for x in rows.column(4)]
    lengths = rows.column(2).to_numpy()
    got = lexical_search.bounds(q, lengths, np.array([len(x) for x in coords]), np.concatenate(coords), np.concatenate(most), 40, int(lengths.sum()))
    for i, t in enumerate(made):
        tf = Counter(TERM.findall(t.translate(ASCII)))
        m = 10 + (90 * int(lengths[i]) * 40) // int(lengths.sum())
        assert got[i, 0] >= sum(w * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for _, x, w in terms if x in tf)


# 12


def nearest_by_hand(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in dict.fromkeys((i, tuple(v)) for i, v in ok if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def nearest(spark, rows, k):
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "block", "g", "score", "rank", "query_id", "ids")
    return sorted(tuple(r) for r in vector_search.top_products(df, k=k).collect())


def test_top_products_equal_all_products(spark):
    rng = np.random.default_rng(5)
    f = lambda v: [float(x) for x in v.astype(np.float32)]
    rows = [(i, f(rng.normal(size=24) / 3)) for i in range(300)]
    rows += [(400 + i, rows[20][1]) for i in range(40)] + [(501, rows[0][1]), (501, rows[0][1]), (20, rows[20][1]), (40, rows[7][1])]
    rows += [(600, None), (601, [0.5, None]), (602, [float("nan")] * 24), (603, [float("inf")] * 24), (None, rows[1][1]), (604, []), (620, []), (605, [1.0]), (640, [2.0, -1.0])]
    assert nearest(spark, rows, 5) == nearest_by_hand(rows, 5)


def test_fewer_rows_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 3.0])]
    assert nearest(spark, rows, 20) == nearest_by_hand(rows, 20)
    assert nearest(spark, [(0, [1.0])], 20) == []
    assert nearest(spark, [], 20) == []


def test_large_numbers_are_exact(spark):
    rows = [(0, [4_000_000.0, 3.0]), (1, [4_000_000.0, 1.0]), (2, [4_000_000.0, 1.015625]), (3, [-1e6, 0.0])]
    assert nearest(spark, rows, 3) == nearest_by_hand(rows, 3)


def test_copies_of_queries_do_not_pass_through_the_driver(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 4), ("GROUPS", 4)):
        monkeypatch.setattr(vector_search, name, value, raising=False)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(rng.normal(size=(400, 8)) / 3)]
    found = vector_search.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(tuple(r) for r in found.collect()) == nearest_by_hand(rows, 5)


def test_segment_bounds_hold_and_spare_work():
    rng = np.random.default_rng(6)
    for width in (1, 7, 64):
        a, b = rng.integers(-40, 40, (30, width)).astype(float), rng.integers(-40, 40, (50, width)).astype(float)
        for segments in (1, 4, 16, 32):
            bound = vector_search.sketch(a, segments) @ vector_search.sketch(b, segments).T
            assert (bound >= a @ b.T - 1e-6).all()
    # vectors of few directions: most pairs are ruled out by the coarse levels
    centres = np.repeat(rng.integers(-30, 30, (40, 8)), 8, axis=1).astype(float)
    rows = centres[rng.integers(0, 40, 4000)] + rng.integers(-2, 3, (4000, 64))
    best = vector_search.Best(np.arange(50), 5)
    first = vector_search.search_block(best, rows[:50], np.arange(400), rows[:400])
    rest = vector_search.search_block(best, rows[:50], np.arange(400, 4000), rows[400:])
    assert first <= 50 * 400 and rest < 0.1 * 50 * 3600
    want = rows[:50] @ rows.T
    want[np.arange(50), np.arange(50)] = -np.inf
    assert (best.least == np.sort(want, axis=1)[:, -5]).all()


# 13


def phrases_by_hand(docs, least, longest=5, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {g: a for g, a in counts.items() if a >= least}
        inside = Counter()
        for g, a in frequent.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], a)
        rows = []
        for g, a in frequent.items():
            if len(g) > 1 and not inside[g] >= a:
                score, k = min(((1000 * a * n[lang]) // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrases(spark, docs, **how):
    df = clash(spark.createDataFrame(docs, "text string, lang string"), "size", "gram", "phrase", "n", "k", "rank", "doc_id")
    return sorted(tuple(r)[:8] for r in collocations.collocations(df, **how).collect())


@pytest.mark.parametrize("least,longest", [(2, 5), (6, 5), (3, 3)])
def test_phrases_equal_counting_all_grams(spark, least, longest):
    rng = random.Random(least)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = [(t, rng.choice(["en", "en", "de", None])) for t in texts(rng, 150)]
    docs += [(f"{rng.choice(VOCAB)} {passage} {rng.choice(VOCAB)}", "en") for _ in range(8)] + [("a a a a a a a", "en")] * 3
    docs += [(None, "en"), (None, None), ("", "en"), (" \t", "fr"), ("...", "fr"), ("one", "it"), ("sun moon " * 30_000, "de"), ("x" * 100_000, "de")]
    got = phrases(spark, docs, min_count=least, longest=longest)
    assert got and got == phrases_by_hand(docs, least, longest)


def test_few_best_and_nothing(spark):
    docs = [("red sun red sun", "en"), ("red sun, red moon", "en"), ("red moon", "en")]
    assert phrases(spark, docs, min_count=2, top=1) == phrases_by_hand(docs, 2, top=1)
    assert phrases(spark, []) == [] == phrases(spark, [(None, None)])


def test_paths_without_branches_become_passages(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(f"{w} {passage} {w}", "en") for w in VOCAB] + [(f"{passage[:30]} other end of it", "de")] * 3, "text string, lang string")
    found = collocations.phrase_counts(collocations.count_edges(docs, 3), 3)
    paths = collocations.compact_paths(found)
    got = {(r["lang"], r["passage"], r["n_words"], r["n"]) for r in collocations.passages(paths, found).collect()}
    assert ("en", passage, 10, len(VOCAB)) in got and ("de", "alpha beta gamma delta epsilon other end of it", 9, 3) in got and len(got) == 2
