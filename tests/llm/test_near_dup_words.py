"""The pipeline's near-duplicate stage against a brute force on five-word shingles."""

import random
import re

import corpus_pipeline
from threadloom.llm import near_dup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows, n):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i for i in sets if find(i) == i}


def test_stage_compares_five_words(spark):
    rng = random.Random(31)
    rows = []
    for g in range(12):
        base = [f"w{g}x{rng.randrange(5000)}" for _ in range(100)]
        rows.append((len(rows), " ".join(base)))
        for edits in (0, 1, 2, 3, 5, 5):
            w = list(base)
            for at in rng.sample(range(100), edits):
                w[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, "a b c"), (901, "A b c"), (902, "a b d"), (903, "one two three four five"), (904, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    five, two = brute_kept(rows, 5), brute_kept(rows, 2)
    assert two < five
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == five
    assert {r.doc_id for r in near_dup.near_duplicates(docs, n=2).filter("kept").collect()} == two


def test_string_ids_and_several_texts_of_one_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [("b", text), ("a", text + " end"), ("c", "quite another text here and there"), ("c", "and a third one"), ("c", "and a third one"), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect() if r.doc_id)
    assert got == [("a", "a"), ("b", "a"), ("c", "c"), ("c", "c"), ("c", "c")]
    kept = sorted((r.doc_id or "", r.text) for r in near_dup.drop_near_duplicates(docs).collect())
    assert kept == [("", text), ("", text), ("a", text + " end"), ("c", "and a third one")]
