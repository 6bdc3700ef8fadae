"""Column expressions on texts that several operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased, for counting.
LETTER_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body names it."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower(), which is faster, where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str) -> Column:
    """All matches of pattern; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def no_longs() -> Column:
    return F.array().cast("array<bigint>")


def gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of tokens, by position; empty where there are fewer than n.

    Word hashes are combined in doubling steps (1, 2, 4, ... words, the last step overlapping), each one pass
    with indexed reads: slice() inside a lambda copies and is several times slower."""

    def widen(h: Column, covers: int) -> Column:
        if covers == n:
            return F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0)))
        step = min(covers, n - covers)
        return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), lambda g: widen(g, covers + step))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: widen(h, 1))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string"))
