"""Line-first quality rules: bad lines go, then documents that lose too much of their text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import SPACE_WORD, gram_hashes, let, words
from threadloom.session import fresh

#: Scripts that put blanks between phrases, not words, and need no marks.
UNSPACED = r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: Fixed values of the line rules.
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here",
    "sign in", "log in", "subscribe now", "enable javascript", "skip to content", "skip to main content",
    "share this", "read more",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "weiterlesen", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "lire la suite", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "haga clic aquí", "leer más", "saltar al contenido",
)
#: Marks that end or part sentences: Latin, Greek, Arabic, Devanagari, Armenian, Ethiopic, Chinese and Japanese.
MARKS = ".!?:;,…·؟؛،۔।॥։።፣。！？：；，、"


@dataclass(frozen=True)
class LineRules:
    """What makes a line fail; phrases and marks are given by the languages of the texts, the rest are limits."""

    phrases: Sequence[str] = BOILERPLATE
    marks: str = MARKS
    symbol_percent: int = 10
    nav_bars: int = 3
    shout_words: int = 4
    bare_words: int = 12
    phrase_chars: int = 200
    lost_percent: int = 50


def has_phrase(text: Column, phrases: Sequence[str] = BOILERPLATE) -> Column:
    return let(F.lower(text), lambda s: F.greatest(F.lit(False), *[s.contains(p) for p in phrases], F.lit(False)))


def line_fails(line: Column, symbols: Column, phrases: Column, rules: LineRules) -> Column:
    """True for a line that is navigation, symbols, shouting, boilerplate, or long prose without any mark.

    symbols, phrases: whether its document has any symbol or boilerplate phrase, so that most documents need no
    further look for them. Prose is a line with a letter of a script that parts its words by blanks. Blank lines never fail."""

    def verdict(s: Column) -> Column:
        bars = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
        marks = F.length(s) - F.length(F.translate(s, SYMBOLS, ""))
        n_words = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
        return (F.length(s) > 0) & (
            (symbols & ((bars >= rules.nav_bars) | (marks * 100 > rules.symbol_percent * F.length(s))))
            | (~s.rlike(r"\p{Ll}") & s.rlike(r"\p{Lu}") & (n_words >= rules.shout_words))
            | ((n_words >= rules.bare_words) & ~s.rlike(f"[{rules.marks}]") & ~s.rlike(UNSPACED))
            | (phrases & (F.length(s) <= rules.phrase_chars) & has_phrase(s, rules.phrases))
        )

    return let(F.trim(line), verdict)


def repeated_window_words(tokens: Column, n: int = 8) -> Column:
    """How many words stand in an n-word window that the text holds twice or more."""

    def covered(h: Column) -> Column:
        # sorted (hash, position) pairs: a repeated window equals a neighbour
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spread(p: Column) -> Column:
            m = F.size(p)
            same = F.filter(
                p,
                lambda x, j: ((j > 0) & (F.get(p, j - 1).h == x.h)).__or__((j < m - 1) & (F.get(p, j + 1).h == x.h)),
            )
            return let(
                F.array_sort(F.transform(same, lambda x: x.i)),
                lambda at: F.aggregate(
                    F.transform(at, lambda x, j: F.when(j < F.size(at) - 1, F.least(F.lit(n), F.get(at, j + 1) - x)).otherwise(F.lit(n))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, spread))

    return let(gram_hashes(tokens, n), covered)


def assess_quality(docs: DataFrame, text: str = "text", out: str = "quality_report", rules: LineRules = LineRules()) -> DataFrame:
    """docs with one more column, a struct named by out (a column of that name is replaced).

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    clean_text, kept. One row per input row, whatever its id; a null or empty text has no words, fails the
    base rule and has null or empty clean_text. Equal rows get equal reports, whatever stands beside them; a very long
    text is judged whole; other columns stay as they are, whatever their names; an empty table stays empty. rules: the line
    rules. All in the row: no shuffle, at any size.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(raw, "\n")

    def counted(x: Column) -> Column:
        filled = F.filter(x.lines, lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(x.words).cast("long").alias("n_words"),
            F.aggregate(x.words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            x.symbols.cast("long").alias("n_symbols"),
            let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            repeated_window_words(x.words).cast("long").alias("n_repeat_words"),
            let(
                F.transform(x.lines, lambda s: F.struct(s.alias("s"), line_fails(s, x.symbols > 0, x.phrases, rules).alias("bad"))),
                lambda marked: F.struct(
                    F.aggregate(F.filter(marked, lambda m: m.bad), F.lit(0).cast("long"), lambda a, m: a + F.length(m.s)).alias("lost_chars"),
                    F.array_join(F.transform(F.filter(marked, lambda m: ~m.bad), lambda m: m.s), "\n").alias("clean_text"),
                ),
            ).alias("cleaned"),
        )

    q = fresh(docs, "__quality")
    n_symbols = F.regexp_count(raw, F.lit(f"[{SYMBOLS}]"))
    parts = F.struct(words(raw, SPACE_WORD).alias("words"), lines.alias("lines"), n_symbols.alias("symbols"), has_phrase(raw, rules.phrases).alias("phrases"))
    measured = docs.withColumn(q, let(parts, counted))
    c = F.col(q)
    failed = (c.n_words < 20) | (c.n_repeat_words * 100 > c.n_words * 30)
    return measured.withColumn(
        out,
        F.struct(
            c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words,
            failed.alias("base_failed"),
            c.cleaned.lost_chars.alias("lost_chars"),
            F.when(F.col(text).isNotNull(), c.cleaned.clean_text).alias("clean_text"),
            (~failed & (c.cleaned.lost_chars * 100 <= F.length(raw) * rules.lost_percent)).alias("kept"),
        ),
    ).drop(q)
