"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import id_crc
from threadloom.session import join_checked, ship, stash

UNKNOWN = "und"
BUCKETS = 4096
WIDTH = 24
#: The sample that trains the model: about so many documents of each language, and of all languages together; with
#: very many languages each gives fewer.
SAMPLE_PER_LANG = 600
SAMPLE_ROWS = 12_000
EPOCHS = 30
#: Answers are rejected below a level above which held-out rows are wrong this often at most, and below which this
#: share of the right ones lies: what scores less than nearly all text of the known languages is none of them.
MAX_WRONG = 0.01
RIGHT_REJECTED = 0.005
#: What counts as a letter, here and in training.
LETTER = r"\p{L}"
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket of hashed byte 2-, 3- and 4-grams occurs in the whole text, in lower case."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), PIECE):
        b = data[at : at + PIECE + 3].astype(np.uint32)
        gram = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            gram = gram[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
            own = gram[:PIECE]  # a gram belongs to the piece that it starts in
            total += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class LanguageModel:
    """logits = mean of the buckets' rows in table, over temperature; langs names its columns. reject_below is a
    level of the logarithm of the best language's odds, which tells apart probabilities that are all but 1."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.astype(np.float64)
        return (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature

    def answer(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """The best language, its probability, and whether it is rejected."""
        z = self.logits(counts)
        best = int(z.argmax())
        return self.langs[best], float(_softmax(z[None, :])[0, best]), bool(_log_odds(z) < self.reject_below)


def _log_odds(z: np.ndarray) -> float:
    """Logarithm of the best logit's odds against all others together."""
    best = int(z.argmax())
    others = np.delete(z, best)
    if not len(others):
        return np.inf
    return float(z[best] - others.max() - np.log(np.exp(others - others.max()).sum()))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(counts: np.ndarray, labels: list[str], seed: int = 7) -> LanguageModel:
    """Fit by mini-batch SGD on nine tenths of the rows; the rest set the temperature and the rejection level."""
    langs = tuple(sorted(set(labels)))
    y = np.array([langs.index(v) for v in labels])
    x = (counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: len(x) // 10] if len(x) >= 40 else order
    fit = order[len(x) // 10 :] if len(x) >= 40 else order
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = 1.0 * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            h = x[rows] @ embed
            g = _softmax(h @ out + bias).astype(np.float32)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ out.T
            out -= rate * (h.T @ g)
            bias -= rate * 0.1 * g.sum(0)
            embed -= rate * 60 * (x[rows].T @ back)
    z = x[held] @ embed @ out + bias
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    model = LanguageModel(langs, (embed @ out).astype(np.float64), bias.astype(np.float64), float(temperature), -np.inf)
    z = [model.logits(counts[i]) for i in held]
    odds, wrong = np.array([_log_odds(v) for v in z]), np.array([int(v.argmax()) for v in z]) != y[held]
    if wrong.all():
        return replace(model, reject_below=np.inf)
    levels = [-np.inf, *np.sort(odds[wrong]) + 1e-9]
    level = next((float(t) for t in levels if (odds >= t).any() and wrong[odds >= t].mean() <= MAX_WRONG), np.inf)
    return replace(model, reject_below=max(level, float(np.quantile(odds[~wrong], RIGHT_REJECTED, method="lower"))))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.slice(at, 128)
            rows = [subword_counts(t).astype(np.float32).tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["h", "lang", "counts"])


def fit_language_model(docs: DataFrame) -> LanguageModel | None:
    """Train on documents whose crc32(id) mod 4 is not 2, with a language and a letter; None if there are none.

    Of each language about SAMPLE_PER_LANG documents are used, and about SAMPLE_ROWS of all, chosen by a hash
    of their ids, whole; every language takes part. The driver gets their bucket counts (16 KB each), not their texts."""
    ship(docs.sparkSession)
    usable = docs.filter((id_crc(F.col("doc_id")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = stash(usable.groupBy(F.col("lang").alias("of")).count(), "language-sizes")
    langs = sizes.count()
    if not langs:
        return None
    each = min(float(SAMPLE_PER_LANG), SAMPLE_ROWS / langs)
    h = F.xxhash64("doc_id", "text", F.lit("language sample"))
    drawn = F.pmod(h, F.lit(1_000_003)) / 1_000_003.0
    sample = join_checked(usable.select(h.alias("h"), drawn.alias("drawn"), "lang", "text"), sizes, F.col("lang") == F.col("of")).filter(F.col("drawn") < each / F.col("count"))
    got = sample.select("h", "lang", "text").mapInArrow(_count_batches, "h long, lang string, counts binary").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    if not len(got):
        return None
    return train(np.stack([np.frombuffer(c.as_buffer(), np.float32) for c in got["counts"]]), got["lang"].to_pylist())


def identify_language(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected.

    Reads doc_id, text, and lang for training only; other columns don't matter. A text that is null or has no
    letter gets 'und' with score 0; so does every text if there is nothing to learn from. A null id is not
    held out (and not learned from). rejected: the calibrated odds of the best language are below the rejection
    level (MAX_WRONG, RIGHT_REJECTED), as it mostly is for noise and for languages never seen; lang_pred is still the
    best guess. Very long texts are read whole, in pieces; repeated rows are answered alike; an empty table stays empty."""
    ship(docs.sparkSession)
    model = model or fit_language_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores, low = [], [], []
            texts, lettered = batch.column(3), batch.column(2).to_pylist()
            for at in range(0, len(batch), 256):
                for t, has_letter in zip(texts.slice(at, 256).to_pylist(), lettered[at : at + 256], strict=True):
                    if m is None or not has_letter:
                        found = UNKNOWN, 0.0, True
                    else:
                        found = m.answer(subword_counts(t))
                    for column, value in zip((langs, scores, low), found, strict=True):
                        column.append(value)
            answers = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *answers], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    letter = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), letter.alias("letter"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
