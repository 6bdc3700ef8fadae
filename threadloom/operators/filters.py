"""Facets, allow-lists and other row and column choices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scalars import basename

VIEW_COLUMNS = ("conversation_id", "provider", "account", "thread_id", "created_at", "updated_at", "turn_count", "char_count")


def date_bound(text: str) -> str:
    """A valid YYYY, YYYY-MM or YYYY-MM-DD bound, or ValueError."""
    m = re.fullmatch(r"([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?", text.strip())
    if not m or (m[2] and not 1 <= int(m[2]) <= 12) or (m[3] and not 1 <= int(m[3]) <= 31):
        raise ValueError(f"not a date bound: {text!r}")
    return m[0]


def date_filter(df: DataFrame, since: str = "", until: str = "", column: str = "created_at") -> DataFrame:
    """Inclusive bounds compared as prefixes of their own width; any bound excludes undated rows; none keeps all."""
    c = F.col(column)
    if since:
        b = date_bound(since)
        df = df.filter((c != "") & (F.substring(c, 1, len(b)) >= b))
    if until:
        b = date_bound(until)
        df = df.filter((c != "") & (F.substring(c, 1, len(b)) <= b))
    return df


def provider_filter(df: DataFrame, provider: str = "") -> DataFrame:
    return df.filter(F.col("provider") == provider) if provider else df


def metadata_view(index: DataFrame) -> DataFrame:
    """The eight columns that may cross a privacy boundary: no title, no free text."""
    return index.select(*VIEW_COLUMNS)


def redact_paths(df: DataFrame, column: str = "rollout_path") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) != "", basename(F.col(column))).otherwise(""))


def order_roots(roots: DataFrame, order: str = "created", limit: int | None = None, offset: int = 0) -> DataFrame:
    """created: oldest first, undated last; recent: newest first; title: by lower case; ties always by id."""
    by = {
        "created": [F.col("created_at_ms").asc_nulls_last(), F.col("id")],
        "recent": [F.col("updated_at_ms").desc_nulls_last(), F.col("id")],
        "title": [F.lower("title"), F.col("id")],
    }[order]
    out = roots.orderBy(*by).offset(offset)
    return out if limit is None else out.limit(limit)
