"""Ranked text search over postings: terms, prefixes, phrases, NEAR, fields, AND / OR / NOT, facets, histogram."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import iso_to_ms, tokenize
from threadloom.operators.filters import date_filter, provider_filter
from threadloom.operators.privacy import strip_hidden_chars
from threadloom.session import stash

#: Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Postings that a task sorts, some 100 bytes each, and the characters of a text that one takes, about.
FILE_POSTINGS, TOKEN_CHARS = 1 << 20, 4


def build_postings(index: DataFrame) -> DataFrame:
    """(term, conversation_id, field, pos) of title and body."""
    per_field = [index.select("conversation_id", F.lit(name).alias("field"), F.posexplode(tokenize(F.col(name))).alias("pos", "term")) for name in ("title", "body")]
    return per_field[0].unionByName(per_field[1]).select("term", "conversation_id", "field", "pos")


def doc_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("len"))


def write_postings(postings: DataFrame, path: str, partitions: int = 32, rows: int = 0) -> None:
    """Postings sorted by term within range partitions, so that min-max statistics prune files by term.

    rows: about how many there are; beyond FILE_POSTINGS a partition there are more of these. A frequent term fills several."""
    order = ["term", "conversation_id", "field", "pos"]
    ranged = postings.repartitionByRange(max(partitions, -(-rows // FILE_POSTINGS)), *order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def store_index(index: DataFrame, path: str, partitions: int = 32) -> None:
    """The index in a folder: heads without bodies, postings sorted by term, and lengths; partitions: files of postings at least."""
    spark = index.sparkSession
    index.drop("body").write.mode("overwrite").parquet(f"{path}/heads")
    heads = spark.read.parquet(f"{path}/heads")
    texts, length = (heads, F.col("char_count")) if "char_count" in heads.columns else (index, F.length("body"))
    chars = texts.agg(F.sum(F.coalesce(length, F.lit(0)) + F.coalesce(F.length("title"), F.lit(0)))).first()[0] or 0
    write_postings(build_postings(index), f"{path}/postings", partitions, chars // TOKEN_CHARS)
    doc_stats(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/stats")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, postings, stats) of a folder that store_index() wrote."""
    return spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


@dataclass(frozen=True)
class Clause:
    """Tokens that must stand next to one another (one token: a term), the last one open with prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False
    field: str | None = None
    near: int | None = None
    others: tuple[Clause, ...] = ()


def _fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


#: A quoted part, which a missing quote leaves open to the end, with a star right after it; or what lies between such parts.
_PARTS = re.compile(r'"([^"]*)(?:"(\*?)|\Z)|([^"]+)')


def parse_query(text: str) -> list[Clause]:
    """User text to clauses that are all required: words, "phrases" (an open quote closes at the end), word*, "phrases"* .

    A word that holds several tokens (file.py) asks for each of them, anywhere; a star opens the last one. Total: any
    input gives a list, an empty one where there is no token."""
    tokens = lambda part: tuple(re.findall(r"[^\W_]+", _fold_text(part)))
    clauses: list[Clause] = []
    for m in _PARTS.finditer(text or ""):
        quoted, star, plain = m.groups()
        if plain is None:
            if found := tokens(quoted):
                clauses.append(Clause(found, prefix=bool(star)))
            continue
        for word in plain.split():
            found = tokens(word)
            clauses += [Clause((t,), prefix=word.endswith("*") and i == len(found) - 1) for i, t in enumerate(found)]
    return clauses


def clause_hits(postings: DataFrame, clause: Clause) -> DataFrame:
    """(conversation_id, tf): how often each conversation holds the clause.

    A phrase needs one shuffle: a token's position less its place in the phrase is the phrase's start, and a
    start that all its tokens agree on is a hit."""
    p = postings if clause.field is None else postings.filter(F.col("field") == clause.field)
    last = len(clause.tokens) - 1

    def here(i: int) -> Column:
        t = clause.tokens[i]
        return F.col("term").startswith(t) if clause.prefix and i == last else F.col("term") == t

    if clause.near is not None:
        # starts meet by bins as wide as the farthest that two of them may lie apart, and by the bins beside these
        width = clause.near + max(len(c.tokens) for c in clause.others)
        here_, beside = (clause_starts(postings, c).withColumn("bin", F.floor(F.col("start") / width)) for c in clause.others)
        a, b = here_.alias("a"), beside.withColumn("bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))).alias("b")
        gap = F.when(F.col("b.start") >= F.col("a.start"), F.col("b.start") - F.col("a.start") - len(clause.others[0].tokens)).otherwise(F.col("a.start") - F.col("b.start") - len(clause.others[1].tokens))
        both = a.join(b, (F.col("a.conversation_id") == F.col("b.conversation_id")) & (F.col("a.field") == F.col("b.field")) & (F.col("a.bin") == F.col("b.bin")) & (gap <= clause.near))
        return both.groupBy(F.col("a.conversation_id").alias("conversation_id")).agg(F.countDistinct("a.field", "a.start").alias("tf"))
    if last == 0:
        return p.filter(here(0)).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("tf"))
    return clause_starts(postings, clause).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("tf"))


def clause_starts(postings: DataFrame, clause: Clause) -> DataFrame:
    """(conversation_id, field, start) of each place where the clause's tokens stand side by side."""
    p = postings if clause.field is None else postings.filter(F.col("field") == clause.field)
    last = len(clause.tokens) - 1
    tests = [F.col("term").startswith(t) if clause.prefix and i == last else F.col("term") == t for i, t in enumerate(clause.tokens)]
    marks = F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]), lambda x: x.isNotNull())
    at = p.filter(reduce(lambda x, y: x | y, tests)).select("conversation_id", "field", "pos", F.explode(marks).alias("i"))
    starts = at.groupBy("conversation_id", "field", (F.col("pos") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("n"))
    return starts.filter(F.col("n") == last + 1).select("conversation_id", "field", "start")


def near(a: Clause, b: Clause, distance: int) -> Clause:
    return Clause(a.tokens + b.tokens, near=distance, others=(a, b))


def match_all(postings: DataFrame, clauses: list[Clause]) -> DataFrame:
    """(conversation_id, clause, tf) of conversations that hold every clause."""
    return complete(match_any(postings, clauses), len(clauses))


def complete(hits: DataFrame, n: int) -> DataFrame:
    """The hits of conversations that have one for each of n clauses."""
    full = hits.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("conversation_id")
    return hits.join(full, "conversation_id", "left_semi")


def match_any(postings: DataFrame, clauses: list[Clause]) -> DataFrame:
    """(conversation_id, clause, tf): the hits of all clauses. Those of one token each are counted in a single pass."""
    single = {i: c for i, c in enumerate(clauses) if len(c.tokens) == 1 and c.near is None and c.field is None}
    parts = [clause_hits(postings, c).select("conversation_id", F.lit(i).alias("clause"), "tf") for i, c in enumerate(clauses) if i not in single]
    if single:
        tests = {i: F.col("term").startswith(c.tokens[0]) if c.prefix else F.col("term") == c.tokens[0] for i, c in single.items()}
        marks = F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in tests.items()]), lambda x: x.isNotNull())
        at = postings.filter(reduce(lambda x, y: x | y, tests.values())).select("conversation_id", F.explode(marks).alias("clause"))
        parts.append(at.groupBy("conversation_id", "clause").agg(F.count(F.lit(1)).alias("tf")))
    return reduce(DataFrame.unionByName, parts)


def match_without(matched: DataFrame, postings: DataFrame, excluded: Clause) -> DataFrame:
    return matched.join(clause_hits(postings, excluded).select("conversation_id"), "conversation_id", "left_anti")


def bm25(matched: DataFrame, hits: DataFrame, stats: DataFrame) -> DataFrame:
    """(conversation_id, bm25), more negative is better; a phrase counts as one unit, frequencies over both fields.

    hits (conversation_id, clause, tf): all hits of the clauses, from which their document frequencies come; matched: those of
    the conversations to rank."""
    size = stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    df = hits.groupBy("clause").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = F.broadcast(df.crossJoin(size).select("clause", idf.alias("idf"), "avg_len"))  # a row for each clause
    scored = matched.join(weights, "clause").join(stats, "conversation_id")
    tf = F.col("tf")
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("conversation_id").agg((-F.sum(part)).alias("bm25"))


def search(index: DataFrame, postings: DataFrame, stats: DataFrame, text: str, since: str = "", until: str = "", provider: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of hits in the order (bm25, id), each with the total of all hits. No token in text: no hits.

    Columns: conversation_id, snippet (the title without hidden characters), score (1 / place among all hits), provider,
    thread_id and ts_ms (null where there is none), bm25, total."""
    clauses = parse_query(text)
    thread = F.nullif("thread_id", F.lit("")) if "thread_id" in index.columns else F.lit(None).cast("string")
    shown = ["conversation_id", strip_hidden_chars(F.col("title")).alias("snippet"), "provider", thread.alias("thread_id"), iso_to_ms(F.col("created_at")).alias("ts_ms")]
    out = ["conversation_id", "snippet", "score", "provider", "thread_id", "ts_ms", "bm25", "total"]
    if not clauses:
        return index.limit(0).select(*shown, F.lit(0.0).alias("score"), F.lit(0.0).alias("bm25"), F.lit(0).cast("long").alias("total")).select(*out)
    hits = stash(match_any(postings, clauses), "hits")  # read three times from here on
    ranked = bm25(complete(hits, len(clauses)), hits, stats)
    rows = stash(provider_filter(date_filter(index, since, until), provider).join(ranked, "conversation_id"), "ranked")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    order = [F.round("bm25", 9), F.col("conversation_id")]
    page = rows.orderBy(*order).offset(offset).limit(limit)  # what follows concerns a page only
    place = F.row_number().over(Window.orderBy(*order)) + offset
    return page.select(*shown, "bm25", (1.0 / place).alias("score")).crossJoin(F.broadcast(total)).select(*out)  # one row


def hits_of(index: DataFrame, postings: DataFrame, clauses: list[Clause], since: str = "", until: str = "", provider: str = "") -> DataFrame:
    wanted = provider_filter(date_filter(index, since, until), provider)
    return wanted.join(match_all(postings, clauses).select("conversation_id").distinct(), "conversation_id", "left_semi")


def search_histogram(hits: DataFrame, bucket: str = "month") -> DataFrame:
    """(bucket, hits) per year, month or day; undated hits in a bucket of their own, '', so the sum is the total."""
    width = {"year": 4, "month": 7, "day": 10}[bucket]
    return hits.groupBy(F.substring("created_at", 1, width).alias("bucket")).agg(F.count(F.lit(1)).alias("hits")).orderBy("bucket")


def search_annotations(notes: DataFrame, text: str = "", tag: str = "") -> DataFrame:
    """Annotations whose alias, tags or notes hold the text, and that have the tag, case apart; neither given: none."""
    if not text.strip() and not tag.strip():
        return notes.limit(0)
    all_text = F.lower(F.concat_ws("\n", "alias", F.array_join("tags", "\n"), "notes"))
    found = notes
    if text.strip():
        found = found.filter(all_text.contains(text.strip().lower()))
    if tag.strip():
        found = found.filter(F.exists("tags", lambda t: F.lower(t) == tag.strip().lower()))
    return found
