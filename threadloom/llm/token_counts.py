"""Token counts of whole texts under a public vocabulary, in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import ship

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of text that are encoded at once, and characters beyond which one text is split.
BATCH_BYTES = 1 << 18
SPLIT_CHARS = 1 << 16
#: The pre-tokenizer always breaks here: before a single space that follows a letter, digit or mark and precedes
#: a letter. No token and no special string crosses such a place.
SAFE = re.compile(r"(?<=[^\s\x00-\x1f])(?= [A-Za-z])")


def split_safely(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """text in pieces of about size characters that are encoded apart as they are together."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


def balanced(sizes: Sequence[int], size: int = BATCH_BYTES) -> Iterator[range]:
    """Runs of indexes of things that have about size bytes together; one that is larger is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > size:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, for a vocabulary file of any of the three kinds."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in own.encode_ordinary_batch(texts, num_threads=1)]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


#: Words whose numbers of tokens a worker remembers, none longer than so many characters; forgotten together beyond that.
KNOWN_WORDS, KNOWN_CHARS = 500_000, 80
_counters: dict[str, tuple[Callable[[list[str]], list[int]], dict[str, int]]] = {}


def count_texts(texts: list[str], count: Callable[[list[str]], list[int]], known: dict[str, int]) -> list[int]:
    """The numbers of tokens of texts whose tokens never cross a safe place: each distinct word is encoded once, many in a batch.

    known remembers words from call to call."""
    words = [SAFE.split(t) for t in texts]
    new = list({w for ws in words for w in ws if w not in known})
    own = {}
    for run in balanced([len(w.encode("utf-8", "surrogatepass")) for w in new]):
        part = new[run.start : run.stop]
        own.update(zip(part, count(part), strict=True))
    if len(known) > KNOWN_WORDS:
        own.update((w, known[w]) for ws in words for w in ws if w in known)
        known.clear()
    known.update((w, n) for w, n in own.items() if len(w) <= KNOWN_CHARS)
    return [sum(known[w] if w in known else own[w] for w in ws) for ws in words]


def _counting(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        splits = not vocabulary.endswith(".model")  # that library's pieces can cross the places that are safe elsewhere
        if vocabulary not in _counters:
            _counters[vocabulary] = counter(vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary)), {}
        count, known = _counters[vocabulary]
        for batch in batches:
            texts, sizes = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2).to_pylist()
            totals = [0] * len(batch)
            for part in balanced(sizes):  # as Python strings, as many as make up a batch
                few = [t or "" for t in texts.slice(part.start, len(part)).to_pylist()]
                pieces = [(part.start + i, p) for i, t in enumerate(few) for p in (split_safely(t) if splits else [t])]
                for run_ in balanced([len(p) for _, p in pieces]):
                    own = [p for _, p in pieces[run_.start : run_.stop]]
                    for (i, _), n in zip(pieces[run_.start : run_.stop], count_texts(own, count, known) if splits else count(own), strict=True):
                        totals[i] += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(totals, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Reads doc_id and text; other columns don't matter. A null text counts as empty: 0 bytes, 0 tokens. Only
    lengths leave the Python workers. A long text is encoded in pieces between which no token can lie; where it has no such
    place, as a single piece. Repeated rows count alike; an empty table stays empty. vocabulary: a file name of the public tokenizers, or a path that all
    executors have."""
    ship(docs.sparkSession)
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = sized.mapInArrow(_counting(vocabulary), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
