"""The numbered operators against brute-force versions and on the awkward inputs: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.llm import decontamination, kneser_ney, language_id, line_dedup, mixing, near_dup, quality_rules, sharding, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "red green blue one two three four five six seven eight nine ten sun moon star tree river stone cloud".split()


def prose(rng, n, end="."):
    return " ".join(rng.choice(VOCAB) + (end if i % 9 == 8 else "") for i in range(n))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)
    if extra:  # names that operators use inside
        for name in ("h", "key", "shard", "rep", "score", "words", "text_hash", "bucket", "weight", "rank", "__piece"):
            df = df.withColumn(name, F.lit("x"))
    return df


AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "   \n\t ", "en", "a"),
    (4, "one", None, "a"),
    (5, "one", "en", None),
    (5, "one", "en", None),
    (None, "no id here at all", "en", "b"),
    (6, "Ünïcødé ſtraße 中文 ‮ text", "de", "b"),
]


def long_text(rng):
    return prose(rng, 30_000)


# ---- 1 ----


def brute_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([1, 2, 4, 5, 7, 9, 10, 11, 25]))) for i in range(25)] + [(90, None), (91, ""), (92, "x y"), (92, "x y"), (93, "X, y!")]
    rows = []
    for i in range(80):
        t = prose(rng, rng.choice([0, 3, 40, 300]))
        if i % 3 == 0:
            t += " " + items[i % 25][1].upper()
        rows.append((i, t, "en", "s"))
    rows += [*AWKWARD, (7, long_text(rng) + " " + items[8][1], "en", "a"), (8, "ha " * 500, "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.contamination(frame(spark, rows, extra=True), bench)
    found = Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert found == brute_contamination([(r[0], r[1]) for r in rows], items)
    kept = decontamination.drop_contaminated(frame(spark, rows, extra=True), bench)
    assert kept.columns == frame(spark, rows, extra=True).columns
    assert kept.count() == sum(n for k, n in found.items() if not k[5])


@pytest.mark.parametrize("broadcast,hot_rows", [(1_000_000, 4096), (0, 4096), (0, 5)])
def test_contamination_by_repeating_and_long_items(spark, monkeypatch, broadcast, hot_rows):
    """Items that repeat themselves or are very long, in bounded time; also when fingerprints are too many to broadcast,
    and with fingerprints of very many chunks, which are spread over tasks."""
    monkeypatch.setattr(decontamination, "FINGERPRINT_ROWS", broadcast)
    monkeypatch.setattr(session, "HOT_ROWS", hot_rows)
    rng = random.Random(51)
    own = [rng.choice(VOCAB) + str(rng.randrange(400)) for _ in range(20_000)]
    items = [(1, "ha " * 1_000), (2, " ".join(own)), (3, "short one"), (4, "ha " * 9 + "ho")]
    rows = [(1, "ha " * 20_000, "en", "a"), (2, "x " * 50 + " ".join(own[5_000:5_040]) + " y", "en", "a"), (3, "clean text", "en", "a"), (4, "so ha ha ha", "en", "a"), (None, " ".join(own[:12]), "en", "a"), (6, "a short one " + "ha " * 9 + "ho ha", "en", "a")]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (20_000, 1), 2: (40, 1), 3: (0, 0), 4: (0, 0), None: (12, 1), 6: (2 + 10, 2)}


def test_contamination_empty_tables(spark):
    docs, bench = frame(spark, AWKWARD), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("length", range(1, 13))
def test_winnowing_finds_each_shared_span(spark, length):
    """Every item length, at any place in a long document, across chunk borders."""
    rng = random.Random(length)
    item = [f"u{i}" for i in range(length)]
    rows = []
    for i, at in enumerate((0, 1, 85, 90, 95, 96, 97, 180, 191, 192, 400)):
        w = [f"w{i}x{j}" for j in range(400)]
        rows.append((i, " ".join(w[:at] + item + w[at:]), "en", "s"))
    rng.shuffle(rows)
    bench = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    got = decontamination.contamination(frame(spark, rows), bench)
    assert [r.n_hit for r in got.collect()] == [length] * len(rows)


# ---- 3 ----


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    rep = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(100 + i, "\n".join(prose(rng, rng.randint(0, 30)) for _ in range(rng.randint(1, 6))) + " #$|" * (i % 3), "en", "s") for i in range(60)]
    rows += [(200, "a b c d e f g h " * 9, "en", "s"), (201, ("x " * 50).strip(), "en", "s"), (202, "l\nl\n\n\nl\n l", "en", "s"), (203, long_text(rng), "en", "s"), *AWKWARD]
    got = quality_rules.assess_quality(frame(spark, rows, extra=True)).select("doc_id", "quality_report.*")
    found = Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert found == Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert quality_rules.assess_quality(frame(spark, rows).limit(0)).count() == 0


def test_line_rules(spark):
    good = "It was a fine day, and the river ran on past the stone. We sat and talked of ships, of storms and of the long way home until dark."
    bad = ["Home | News | Sport | About", "buy### now$$$ cheap%%% deal***", "THIS IS ALL SHOUTING!!", "word " * 15, "Please read our Cookie Policy."]
    rows = [(1, good, "en", "s"), (2, "\n".join([good, *bad]), "en", "s"), (3, "\n".join([bad[3]] * 9 + [good]), "en", "s"), (4, good + "\n\n" + good + "x", "en", "s")]
    got = {r.doc_id: r for r in quality_rules.assess_quality(frame(spark, rows)).select("doc_id", "quality_report.*").collect()}
    assert got[1].kept and got[1].clean_text == good
    assert got[2].clean_text == good
    assert not got[3].kept
    assert got[4].clean_text == rows[3][1]  # blank lines stay


# ---- 4 ----


def brute_mix(rows, percent, epochs, weights, domain):
    tokens = lambda t: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    leaves = defaultdict(int)
    for i, t, lang, src in rows:
        leaves[(domain(src or ""), lang or "", src or "")] += tokens(t)
    total = sum(leaves.values()) * percent // 100

    def deal(given, level, prefix):
        kids = sorted({k[level] for k in leaves if k[:level] == prefix})
        cap = {c: epochs * sum(v for k, v in leaves.items() if k[: level + 1] == (*prefix, c)) for c in kids}
        w = {c: weights.get("/".join((*prefix, c)), 1) for c in kids}
        given, out, open_ = min(given, sum(cap.values())), {}, list(kids)
        left = given
        while open_:
            share = sum(w[c] for c in open_)
            dry = [c for c in open_ if cap[c] * share <= left * w[c]]
            if not dry:
                for c in open_:
                    out[c] = left * w[c] // share
                break
            first = min(dry, key=lambda c: (cap[c] / w[c], c))
            out[first] = cap[first]
            left -= cap[first]
            open_.remove(first)
        return {(*prefix, c): b for c, b in out.items()}

    budgets = {(): total}
    for level in range(3):
        budgets = {k: b for p, g in budgets.items() for k, b in deal(g, level, p).items()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = Counter()
    for leaf, budget in budgets.items():
        whole, rest = divmod(budget, leaves[leaf])
        own = [(md5(f"mix-1:{whole}:{'' if i is None else i}:{md5(t or '')}"), i, tokens(t)) for i, t, lang, src in rows if (domain(src or ""), lang or "", src or "") == leaf]
        for spot, i, n in own:
            upto = sum(m for s, _, m in own if s <= spot)
            for e in range(whole + (upto <= rest)):
                out[(i, *leaf, e, n, budget)] += 1
    return out


@pytest.mark.parametrize("percent, weights", [(50, {}), (100, {"y": 5}), (30, {"x": 3, "x/en": 7, "y/en/b": 4}), (150, {"other": 9}), (0, {})])
def test_mix_equals_brute_force(spark, percent, weights):
    rng = random.Random(percent)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)] + AWKWARD
    w = spark.createDataFrame(list(weights.items()), "path string, weight long") if weights else None
    domains = {"a": "x", "b": "y"}
    got = mixing.mix_sources(frame(spark, rows, extra=True), mixing.domain_of(F.col("source"), domains), w, budget_percent=percent).select("doc_id", "mix.*")
    domain = lambda s: domains.get(s, "other")
    assert Counter(tuple(r) for r in got.collect()) == brute_mix(rows, percent, 4, weights, domain)


def test_mix_deals_to_very_many_sources(spark):
    """Also where many children run dry at one ratio, or within one step of ratios."""
    rng = random.Random(41)
    rows = [(i, prose(rng, rng.choice([1, 2, 3, 40, 41, 42])), "en", f"s{i % 90}") for i in range(400)]
    weights = {f"other/en/s{i}": rng.choice([1, 2, 3]) for i in range(0, 90, 2)}
    w = spark.createDataFrame(list(weights.items()), "path string, weight long")
    got = mixing.mix_sources(frame(spark, rows), weights=w, budget_percent=55, max_epochs=1).select("doc_id", "mix.*")
    assert Counter(tuple(r) for r in got.collect()) == brute_mix(rows, 55, 1, weights, lambda s: "other")


CLASHING = ["budget", "whole", "rest", "buckets", "end_bucket", "last_spot", "leaf", "domain", "epoch", "tokens", "spot", "bucket", "label", "n_tokens", "at", "left", "share"]
CLASHING += ["bytes_before", "rows_before", "__piece", "__mix", "__limits", "__Epoch", "__shard", "__place", "piece", "bytes", "rows", "row", "to", "r", "sub", "size", "crc", "id", "key", "gone_id", "k_id", "k_hash", "a.b"]


@pytest.mark.parametrize("operator", [lambda d: mixing.mix_sources(d, budget_percent=100, max_epochs=1), sharding.shard_documents, near_dup.drop_near_duplicates, lambda d: decontamination.drop_contaminated(d, d.select(F.lit(1).alias("item_id"), F.lit("no such words").alias("text")))])
def test_columns_of_any_name_keep_their_values(spark, operator):
    docs = frame(spark, [(i, f"text number {i}", "en", "s") for i in range(20)] + [(3, "text number 3", "en", "s"), (3, "another", "en", "s")])
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    got = operator(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert rows and all(r[name] == f"{name}{r.doc_id}" for r in rows for name in CLASHING)


def test_mix_does_not_depend_on_buckets(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 30)), "en", "hot" if i % 3 else "b") for i in range(300)]
    take = lambda: sorted(r.doc_id for r in mixing.mix_sources(frame(spark, rows), max_epochs=1).collect())
    a = take()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert take() == a
    assert mixing.mix_sources(frame(spark, rows).limit(0)).count() == 0


# ---- 5 ----


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [t for _, t, _, _ in AWKWARD] + ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endo", "\r\n\t x  y   \n\n z ", "naïve çédille Œuvre", "don't I'll 'tis 12345 $%^", "x" * 200_000, " " * 5000 + "a", long_text(rng)[:150_000], "\x00\x01 \x7f b", "日本語 テキスト 🙂🙂"]
    texts += ["".join(rng.choice("ab cd\n\t.é'1<|>") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    got = token_counts.token_counts(frame(spark, rows, extra=True)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(frame(spark, rows).limit(0)).count() == 0


def test_token_counts_of_whole_tables_equal_the_library(spark):
    """Every document of a driver's table, counted by the library of the .json file too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, (len(e.ids) for e in library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False)), strict=True))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == want


def test_batches_are_balanced_by_bytes():
    sizes = [10, 10, 10, 100, 1, 1, 1, 30]
    runs = list(token_counts.balanced(sizes, 30))
    assert [i for r in runs for i in r] == list(range(8)) and all(len(r) == 1 or sum(sizes[i] for i in r) <= 30 for r in runs)
    assert list(token_counts.balanced([], 30)) == []


@pytest.mark.parametrize("vocabulary", ["byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_vocabularies(spark, vocabulary):
    import public_tokenizers

    texts = ["one two three", "", "Hello,  World!\nnew line", "œuvre 12"]
    got = token_counts.token_counts(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), vocabulary).collect()
    count = token_counts.counter(public_tokenizers.path(vocabulary))
    assert [r.n_tokens for r in sorted(got)] == count(texts)


def test_split_safely_changes_no_count():
    import public_tokenizers

    rng = random.Random(6)
    count = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    for _ in range(40):
        t = "".join(rng.choice(["the", " ", " a", "\n", "'s", " 12", "é", "<|endoftext|>", ".", "  ", " "]) for _ in range(300))
        parts = token_counts.split_safely(t, 20)
        assert "".join(parts) == t and sum(count(parts)) == count([t])[0]


# ---- 6 ----


def brute_near(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if rows[x][0] is None or rows[y][0] is None:
                continue
            k = len(a & b)
            if rows[x][0] == rows[y][0] or (a and b and 100 * k >= 80 * (len(a) + len(b) - k)):
                up[find(x)] = find(y)
    least = {}
    for x, r in enumerate(rows):
        if r[0] is not None:
            least[find(x)] = min(least.get(find(x), r[0]), r[0])
    return Counter((r[0], len(sets[x]), least.get(find(x)) if sets[x] else r[0], r[0] is None or (least[find(x)] if sets[x] else r[0]) == r[0]) for x, r in enumerate(rows))


def edited(rng, words, share):
    return [rng.choice(VOCAB) + str(rng.randint(0, 40)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed,hot_rows", [(0, 4096), (1, 4096), (2, 4096), (0, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, hot_rows):
    """Groups of copies, of near copies with edits of all sizes, and chains in which only neighbours are linked; also with
    centers whose members fill several blocks."""
    monkeypatch.setattr(session, "HOT_ROWS", hot_rows)
    rng = random.Random(seed)
    rows, n = [], 0
    for size, share in ((12, 0.0), (60, 0.1), (40, 0.06), (25, 0.2)):
        base = [rng.choice(VOCAB) + str(rng.randint(0, 30)) for _ in range(120)]
        for _ in range(size):
            rows.append((n := n + 1, " ".join(edited(rng, base, share * rng.random() * 2)), "en", "s"))
    chain = [f"c{i}" for i in range(100)]
    for i in range(15):
        rows.append((n := n + 1, " ".join(chain), "en", "s"))
        chain[i * 6 : i * 6 + 3] = [f"d{i}a", f"d{i}b", f"d{i}c"]
    rows += [(1000 + i, prose(rng, 50), "en", "s") for i in range(30)]
    rows += [(2000, "one", "en", "s"), (2001, "ONE", "en", "s"), (2002, "", "en", "s"), (2003, None, "en", "s"), (2004, "b a", "en", "s"), (2005, "a b", "en", "s"), (None, "one", "en", "s")]
    got = near_dup.near_duplicates(frame(spark, rows, extra=True))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute_near(rows)


def test_near_duplicates_of_repeated_rows_and_none(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, "A b c", "en", "s"), (None, None, None, None), (3, long_text(random.Random(9)), "en", "s")]
    assert Counter(tuple(r)[2:] for r in near_dup.near_duplicates(frame(spark, rows)).collect()) == Counter({(1, True): 2, (1, False): 1, (None, True): 1, (3, True): 1})
    kept = near_dup.drop_near_duplicates(frame(spark, rows, extra=True))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert near_dup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


# ---- 7 ----


def test_shards_equal_a_plain_running_sum(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "same text" if i % 3 == 0 else prose(rng, rng.randint(0, 200)), "en", "s") for i in range(400)] + AWKWARD[:4] + [(900, long_text(rng), "en", "s")]
    key = F.struct(sharding.shard_key(F.col("text"), F.col("doc_id")).alias("k"), "doc_id")
    order = frame(spark, rows).select("doc_id", "text", key.alias("key")).orderBy("key").collect()
    size = lambda t: len((t or "").encode()) + 1
    total, at, want, slots = sum(size(r.text) for r in order), 0, {}, Counter()
    for r in order:
        s = at * 16 // total
        want[r.doc_id] = (size(r.text), zlib.crc32((r.text or "").encode()), s, slots[s])
        slots[s] += 1
        at += size(r.text)
    for splitters, piece in ((256, 20_000), (8, 16)):
        monkeypatch.setattr(sharding, "RANGES", splitters)
        monkeypatch.setattr(sharding, "PIECE_ROWS", piece)
        got = sharding.shard_documents(frame(spark, rows, extra=True)).select("doc_id", "placement.*").collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_shards_of_awkward_rows(spark):
    got = sharding.shard_documents(frame(spark, AWKWARD)).select("placement.*").collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(AWKWARD) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(frame(spark, AWKWARD).limit(0)).count() == 0


# ---- 2, 8, 10: held-out accuracy ----

SYLLABLES = {"en": "the ing tion er and", "fr": "eau oux ré que ent", "de": "sch ung ber ein ü"}
RARE = {"xx": "zla kvo pry dž ňa"}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice((SYLLABLES | RARE)[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def test_language_id(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 80)), lang, "s") for i in range(400)]
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !? 45", "en", "s"), (1003, speech(rng, "de", 20_000), None, None), (None, "sch ung ein", "de", "s")]
    got = language_id.identify_language(frame(spark, rows, extra=True)).collect()
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify_language(frame(spark, rows).limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(frame(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def test_language_rejection(spark):
    """Texts of a language never seen and noise are rejected, nearly all known ones are not; rare languages are learned."""
    rng = random.Random(18)
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(20, 80)), lang, "s") for i in range(900)]
    rows += [(2000 + i, speech(rng, "xx", 40), "xx", "s") for i in range(40)]
    strange = [(5000 + i, " ".join("".join(rng.choice("wakizumo") for _ in range(6)) for _ in range(40)), None, "s") for i in range(40)]
    noise = [(6000 + i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(100)), None, "s") for i in range(40)]
    rows += strange + noise + [rows[0]] * 2
    got = {r.doc_id: r for r in language_id.identify_language(frame(spark, rows)).collect()}
    assert sum(got[i].rejected for i in range(900)) <= 30
    assert sum(got[i].rejected for i, *_ in strange + noise) >= 72
    assert sum(got[2000 + i].lang_pred == "xx" for i in range(40)) >= 38


def test_subword_counts_do_not_depend_on_pieces(monkeypatch):
    text = speech(random.Random(1), "fr", 3000)
    whole = language_id.subword_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 97)
    assert (language_id.subword_counts(text) == whole).all()


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["idiot", "scumbag", "moron", "trash"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(rng, rng.randint(5, 80)).split(), int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, toxic))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (1002, "idiot moron " * 20_000, "en", "s"), (None, "moron idiot trash", "en", "s")] + [rows[7]] * 3
    lab = spark.createDataFrame([*labels, (1001, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra=True)
    got = toxicity.score_toxicity(docs, toxicity.learn_grammar(docs, lab)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[1000], by[1001], by[1002]) == (0, 0, 1)
    assert len(got) == len(rows) and toxicity.score_toxicity(docs.limit(0), toxicity.Grammar({})).count() == 0
    none = toxicity.learn_grammar(docs, lab.limit(0))
    assert not toxicity.learn_grammar(docs.limit(0), lab).entries
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}


def brute_perplexity(rows, trusted, quantile):
    """{(id, lang, text): (perplexity, kept)} with a model of dictionaries, recursively."""
    n, start = kneser_ney.ORDER, chr(kneser_ney.START)
    grams_of = lambda t: [(start * (n - 1) + t)[i : i + n] for i in range(len(t))]
    calibrates = lambda i: zlib.crc32(str(i).encode()) % kneser_ney.CALIBRATION == 0
    out, by_lang = {}, defaultdict(list)
    for i, t, lang, _ in rows:
        by_lang[lang].append((i, (t or "").replace("\0", chr(kneser_ney.MARK)), t))
    for lang, own in by_lang.items():
        counts = {n: Counter(g for i, t, _ in own if i in trusted and not calibrates(i) for g in grams_of(t))}
        for k in range(n - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        cuts, sums, taken = {}, {}, {}
        for k, c in counts.items():
            m = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
            cuts[k] = [0.5, 0.75, 0.9]
            if m[0] and m[1] and m[2]:
                y = m[0] / (m[0] + 2 * m[1])
                cuts[k] = [min(max(j - (j + 1) * y * m[j] / m[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]
            sums[k], taken[k] = Counter(), Counter()
            for g, v in c.items():
                sums[k][g[:-1]] += v
                taken[k][g[:-1]] += cuts[k][min(v, 3) - 1]

        def p(g):
            k = len(g)
            if not k:
                return 1 / (len(counts[1]) + 1)
            if not sums[k][g[:-1]]:
                return p(g[1:])
            v = counts[k][g]
            return ((v - cuts[k][min(v, 3) - 1] if v else 0) + taken[k][g[:-1]] * p(g[1:])) / sums[k][g[:-1]]

        steps, judged = [], {}
        for i, t, raw in own:
            cost = [-math.log(p(g)) for g in grams_of(t)] if counts[1] else []
            if cost:
                mean = sum(cost) / len(cost)
                sd = math.sqrt(max(0.0, sum(x * x for x in cost) / len(cost) - mean * mean) / len(cost))
                judged[i, lang, raw] = mean, math.ceil((mean - kneser_ney.MARGIN * sd) * kneser_ney.STEPS)
                if i in trusted and calibrates(i):
                    steps.append(judged[i, lang, raw][1])
        rank = math.ceil((len(steps) + 1) * quantile - 1e-9)
        top = sorted(steps)[rank - 1] if 0 < rank <= len(steps) else math.inf
        for i, t, raw in own:
            mean, step = judged.get((i, lang, raw), (None, -math.inf))
            out[i, lang, raw] = (mean, bool(t) and step <= top)
    return out


def quality_corpus(rng):
    rows = [(i, speech(rng, lang := rng.choice(["en", "fr"]), rng.randint(6, 30)), lang, "s") for i in range(300)]
    junk = [(500 + i, "".join(rng.choice("@#%!{}qxzXW ") for _ in range(200)), "en", "s") for i in range(20)]
    rows += [*junk, (900, None, None, None), (901, "", "en", "s"), (902, speech(rng, "fr", 3_000), "xx", None), (903, "in the \\0 zero", "en", "s"), (904, "no language", None, "s")]
    return rows + [rows[3], rows[3], (7, "another text of seven", "en", "s"), (None, "no id", "en", "s")], junk


@pytest.mark.parametrize(("hot", "piece"), [(1 << 20, 1 << 20), (200, 50), (0, 1 << 20)])
def test_quality_classifier_equals_brute_force(spark, monkeypatch, hot, piece):
    """Also with grams that are not broadcast, with texts in pieces, and with both."""
    rows, junk = quality_corpus(random.Random(12))
    monkeypatch.setattr(kneser_ney, "HOT_GRAMS", hot)
    if piece < 1 << 20:  # the workers import the module anew, so pieces are tried in this process
        whole = [g for t in ("", "a", "ab" * 300, rows[322][1]) for g in [np.concatenate([*(kneser_ney.gram_keys(p, np.uint64(5)) for p in kneser_ney.code_points(t)), np.zeros(0, np.uint64)])]]
        monkeypatch.setattr(kneser_ney, "PIECE", piece)
        cut = [g for t in ("", "a", "ab" * 300, rows[322][1]) for g in [np.concatenate([*(kneser_ney.gram_keys(p, np.uint64(5)) for p in kneser_ney.code_points(t)), np.zeros(0, np.uint64)])]]
        assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    trusted = set(range(0, 300))
    ids = spark.createDataFrame([(i,) for i in trusted] * 2, "doc_id long")
    got = kneser_ney.classify_quality(frame(spark, rows, extra=True), ids, quantile=0.9).collect()
    want = brute_perplexity(rows, trusted, 0.9)
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        seen[r.doc_id, r.lang].append((r.perplexity, r.kept, r.n_grams))
    for (i, lang, text), (mean, kept) in want.items():
        assert any(k == kept and n == len(text or "") and (p is None) == (mean is None) and (p is None or p == pytest.approx(math.exp(mean), rel=1e-6)) for p, k, n in seen[i, lang]), (i, lang)
    assert not any(k for i, *_ in junk for _, k, _ in seen[i, "en"])
    by = {k: v[0][:2] for k, v in seen.items()}
    assert (by[900, None], by[901, "en"], by[902, "xx"], by[904, None]) == ((None, False), (None, False), (None, True), (None, True))


def test_quality_classifier_without_trust_or_rows(spark):
    rows, _ = quality_corpus(random.Random(13))
    none = spark.createDataFrame([], "doc_id long")
    free = kneser_ney.classify_quality(frame(spark, rows), none).collect()
    assert len(free) == len(rows) and all(r.kept == bool(r.n_grams) for r in free)
    assert kneser_ney.classify_quality(frame(spark, rows).limit(0), none).count() == 0


def test_thresholds_need_enough_rows(spark):
    rows = [("a", s) for s in range(1, 100)] + [("b", s) for s in range(1, 99)]
    got = kneser_ney.thresholds(spark.createDataFrame(rows, "lang string, step long"), 0.99).collect()
    assert [(r.lang, r.threshold) for r in got] == [("a", 99)]


# ---- 9 ----


def brute_lines(rows, most):
    sites = defaultdict(set)
    for _, t, _, src in rows:
        for line in (t or "").split("\n"):
            s = line.strip(" ")
            if len(s) >= 1 and src is not None:
                sites[s].add(src)
    out = Counter()
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if len(sites[x.strip(" ")]) < most]
        out[(i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("most", [2, 10, 40])
def test_line_dedup_equals_brute_force(spark, most):
    rng = random.Random(most)
    shared = [f"shared line number {k} of this test" for k in range(60)]
    rows = []
    for i in range(500):
        lines = [prose(rng, 8) + str(i) for _ in range(3)] + [" " * (i % 3) + x for k, x in enumerate(shared) if rng.random() < k / 300]
        rng.shuffle(lines)
        rows.append((i, "\n".join([*lines, "", "short one"]), "en", f"site{rng.randint(0, 60)}" if i % 50 else None))
    rows += [*AWKWARD, (7, long_text(rng), "en", "z")]
    got = line_dedup.dedup_lines(frame(spark, rows, extra=True), min_sites=most)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "clean_text").collect()) == brute_lines(rows, most)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


# ---- pipeline ----


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 60 + rng.randint(0, 80)) + f" tail{i}.", "en", f"src{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[0][1], "en", "src9") for i in range(40)]  # copies
    rows += [(300 + i, rows[1][1] + f" more{i}.", "en", "src1") for i in range(20)]  # near copies
    rows += [(400 + i, prose(rng, 50) + " " + item + " " + prose(rng, 40), "en", "src2") for i in range(5)]  # leaks
    rows += [(500, "too short", "en", "src2"), (501, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    docs, counts = frame(spark, rows), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append({r.doc_id for r in docs.collect()})
    passed = [r for r in rows if not brute_quality(r[1])[5]]
    assert counts[0] == {r[0] for r in passed}
    assert counts[1] == {k[0] for k in brute_near(passed) if k[3]}
    assert counts[2] == counts[1] - {400 + i for i in range(5)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= counts[2] and len(out) == len({r.doc_id for r in out})
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    empty = frame(spark, rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_math_of_the_band():
    assert line_dedup.BAND == pytest.approx(6 * 1.04 / math.sqrt(2**line_dedup.LOG_K))
