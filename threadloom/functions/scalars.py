"""Small scalar functions, each one Spark column expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body names it."""
    return F.transform(F.array(value), body).getItem(0)


def iso_to_ms(col: Column) -> Column:
    """ISO-8601 text to epoch milliseconds; blank and junk give null, naive stamps count in the session's zone."""
    return F.unix_millis(F.try_to_timestamp(F.nullif(F.trim(col), F.lit(""))))


def epoch_to_iso(seconds: Column) -> Column:
    """Epoch seconds to an ISO text in UTC with milliseconds kept only where there are some; null gives ''."""
    stamp = F.timestamp_seconds(seconds)
    whole = F.unix_millis(stamp) % 1000 == 0
    return F.coalesce(F.when(whole, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.lit(""))


def first_line(col: Column, width: int = 80) -> Column:
    return F.substring(F.element_at(F.split(F.ltrim(F.coalesce(col, F.lit(""))), "\n"), 1), 1, width)


def preview(col: Column, width: int = 200) -> Column:
    return F.substring(F.coalesce(col, F.lit("")), 1, width)


def normalise_prompt(col: Column) -> Column:
    """No-break blanks to blanks, runs of white space to one, outer white space off, lower case."""
    spaced = F.regexp_replace(F.coalesce(col, F.lit("")), "[\\u00A0\\s]+", " ")
    return F.lower(F.trim(spaced))


def flatten_content(col: Column) -> Column:
    """Text of JSON content: a string, a list of strings or parts {type, text}, nested lists one deep; media as a label."""
    part = "struct<type:string,text:string,content:string>"
    as_list = F.from_json(col, f"array<{part}>")
    texts = F.transform(as_list, lambda p: F.when(p.text.isNotNull(), p.text).when(p.type.contains("image"), F.lit("[image]")).otherwise(F.lit("")))
    strings = F.from_json(col, "array<string>")
    plain = F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$.v")
    return (
        F.when(F.trim(col).startswith("[{"), F.array_join(F.filter(texts, lambda t: t != ""), "\n"))
        .when(F.trim(col).startswith("["), F.array_join(F.filter(strings, lambda t: t.isNotNull() & (t != "")), "\n"))
        .otherwise(F.coalesce(plain, F.lit("")))
    )


def safe_file_name(title: Column, index: Column, width: int = 60) -> Column:
    """'%03d-' and the title without characters that file systems refuse."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', " "), r"\s+", " ")
    trimmed = F.trim(F.substring(F.trim(bare), 1, width))
    return F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("-"), F.when(trimmed == "", F.lit("untitled")).otherwise(trimmed))


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def uuid_in(path: Column) -> Column:
    """The UUID in a file name, '' without one."""
    return F.regexp_extract(F.element_at(F.split(path, r"[/\\]"), -1), UUID, 0)


def is_uuid(col: Column) -> Column:
    return F.coalesce(col.rlike(f"^{UUID}$"), F.lit(False))


def decoded_dir(col: Column) -> Column:
    """Percent-decoding in which + stays +; undecodable input stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def clean_tags(tags: Column) -> Column:
    """Tags with white space collapsed and blanks gone, one per spelling regardless of case (the first), in order."""
    tidy = F.filter(F.transform(tags, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    first = let(tidy, lambda a: F.filter(a, lambda t, i: ~F.exists(F.slice(a, 1, i), lambda s: F.lower(s) == F.lower(t))))
    return F.transform(F.array_sort(F.transform(first, lambda t: F.struct(F.lower(t).alias("k"), t.alias("t")))), lambda x: x.t)


def account_of(json: Column) -> Column:
    """An account object's uuid, else its e-mail."""
    pick = lambda *p: F.nullif(F.coalesce(*[F.get_json_object(json, x) for x in p]), F.lit(""))
    return F.coalesce(pick("$.uuid"), pick("$.email_address", "$.email"), F.lit(""))


def ms_to_fraction(ms: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi <= lo, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ms - lo) / (hi - lo))))


def fraction_to_ms(x: Column, lo: Column, hi: Column) -> Column:
    return F.round(lo + F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * (hi - lo)).cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _folding()


def fold(col: Column) -> Column:
    """Lower case without Latin diacritics; the one place that decides how text is compared without case."""
    return F.translate(F.lower(col), MARKED, BARE)


def tokenize(col: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_safe_url(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col)).rlike(r"^https?://[^\s/]"), F.lit(False))


def is_local_media_path(col: Column) -> Column:
    """A relative path without scheme, drive, root or step upwards: no colon in its first part, of whatever kind."""
    p = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("/"))
    steps = F.split(p, "/")
    return (p != "") & ~p.contains("://") & ~p.startswith("/") & ~steps[0].contains(":") & ~F.array_contains(steps, "..")
