"""Names with slashes, null domains, clashing columns, other scripts, digits that look like letters."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import language_id, mixing, quality_rules, token_counts

WORDS = "ein zwei drei vier fünf sechs sieben acht neun zehn".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, " ".join(["w"] * 10), lang, src, dom) for i, (dom, lang, src) in enumerate(rows)], "doc_id long, text string, lang string, source string, dom string")


@pytest.mark.parametrize("families", [
    [("a", "b/c", "s"), ("a/b", "c", "s")],
    [("a", "b", "c/d"), ("a", "b/c", "d")],
    [("a/b", "x/y", "p/q"), ("a", "b/x", "y/p/q")],
])
def test_slashes_in_names_keep_families_apart(spark, families):
    df = docs(spark, families * 20)
    got = mixing.mix_sources(df, F.col("dom"), max_epochs=1).select("doc_id", "mix.domain", "mix.lang", "mix.source", "mix.budget").collect()
    assert len(got) == 20 and len({r.doc_id for r in got}) == 20
    assert {(r.domain, r.lang, r.source): r.budget for r in got} == {f: 100 for f in families}


def test_weights_by_arrays_of_names(spark):
    df = docs(spark, [("a/b", "c", "s"), ("a", "b", "c"), ("a", "b", "c"), ("a/b", "c", "s")] * 10)
    weights = spark.createDataFrame([(["a/b"], 3), (["a"], 1)], "path array<string>, weight long")
    got = mixing.mix_sources(df, F.col("dom"), weights, max_epochs=1).groupBy("mix.domain").count().collect()
    assert {r.domain: r["count"] for r in got} == {"a/b": 15, "a": 5}
    texts = spark.createDataFrame([("a", 3), ("a/b", 1)], "path string, weight long")
    got = mixing.mix_sources(docs(spark, [("a", "b", "s"), ("z", "b", "s")] * 10), F.col("dom"), texts, max_epochs=1).groupBy("mix.domain").count().collect()
    assert {r.domain: r["count"] for r in got} == {"a": 7, "z": 2}  # of 100 words 75 and 25, in documents of 10


def test_null_domains_are_kept(spark):
    df = docs(spark, [("a", "x", "s"), (None, "x", "s")] * 20)
    got = mixing.mix_sources(df, F.col("dom"), budget_percent=100, max_epochs=1).groupBy("mix.domain").count().collect()
    assert {r.domain: r["count"] for r in got} == {"a": 20, mixing.OTHER: 20}


def test_quality_report_leaves_other_columns(spark):
    df = spark.createDataFrame([(1, "some text. " * 30, "mine", "too")], "doc_id long, text string, __quality string, n_words string")
    row = quality_rules.assess_quality(df).first()
    assert (row["__quality"], row["n_words"], row["doc_id"]) == ("mine", "too", 1) and row["quality_report"].n_words == 60


def test_prose_of_other_scripts_passes(spark):
    rng = random.Random(1)
    line = lambda letters, end: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(14)) + end
    texts = [line("абвгд", "."), line("あいうえお", "。"), line("ابتثج", "؟"), line("अआइईउ", "।"), line("กขคงจ", ""), line("աբգդե", "։")]
    bare = [line("абвгд", ""), line("abcde", "")]
    df = spark.createDataFrame([(i, "\n".join([t] * 1 + [line("abcde", ".") for _ in range(3)])) for i, t in enumerate(texts + bare)], "doc_id long, text string")
    lost = {r.doc_id: r.lost for r in quality_rules.assess_quality(df).select("doc_id", F.col("quality_report.lost_chars").alias("lost")).collect()}
    assert [lost[i] > 0 for i in range(8)] == [False] * 6 + [True] * 2


def test_line_rules_are_parameters(spark):
    df = spark.createDataFrame([(1, "buy now at once\n" + "ordinary words stand here, and so on. " * 3)], "doc_id long, text string")
    lost = lambda **how: quality_rules.assess_quality(df, rules=quality_rules.LineRules(**how)).first().quality_report.lost_chars
    assert lost() == 0 and lost(phrases=("buy now",)) == 15 and lost(marks="§", bare_words=3) > 15 and lost(phrases=()) == 0


def test_long_text_and_empty_table_of_lines(spark):
    df = spark.createDataFrame([(1, ("a line of words, in order.\n" * 40_000)), (2, None)], "doc_id long, text string")
    first = quality_rules.assess_quality(df).filter("doc_id = 1").first().quality_report
    assert first.n_words == 240_000 and first.n_dup_lines == 39_999 and first.base_failed
    assert quality_rules.assess_quality(df.limit(0)).count() == 0


def test_digits_and_marks_are_no_letters(spark):
    rows = [(i, " ".join(random.Random(i).choice(WORDS) for _ in range(30)), "de") for i in range(60)] + [(100, "² ½ ³", None), (101, "Ⅷ ⅻ", None), (102, "12 _ 7", None), (103, "", None), (104, None, None), (105, "zwei ²", None), (105, "zwei ²", None)]
    got = {r.doc_id: r for r in language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all((got[i].lang_pred, got[i].score) == (language_id.UNKNOWN, 0.0) for i in range(100, 105)) and got[105].lang_pred == "de"


def test_token_counts_of_all_kinds_of_text_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    texts = ["plain words", "Ünïcode — “quotes”", "日本語のテキスト", "<|endoftext|> inside", "a\n\n b\t c", "x" * 3000, "mixed 日本 and <|endoftext|> plain " * 50, "", "²½", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.n_tokens for r in token_counts.token_counts(df).orderBy("doc_id").collect()]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
