"""Toxicity by a weighted finite-state grammar: five transducers, composed, that score matched clauses.

A clause is read as a string of classes, one for each word (`classify`). The insult transducer writes HIT for a
learned insult with the learned weight; the threat transducer writes MENACE for a threat that has its object close by, after
the verb or before it as the language has it; the target transducer rewards hits in a clause that names a target; negation
and reported speech take weight off the hits that they reach. Weights add up along a path and a clause is worth its
best accepting path. Every match may also be passed over for nothing, so no clause is worth less than 0.

The word lists of the languages are declared (`WORD_LISTS`); the insults, and what context adds or takes away, are
learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import id_crc
from threadloom.session import join_checked, ship, stash

@dataclass(frozen=True)
class WordLists:
    """What a language has besides insults. objects are the words that a threat can fall on, object_first where they stand."""

    threats: frozenset[str]
    objects: frozenset[str]
    targets: frozenset[str]
    negations: frozenset[str]
    reports: frozenset[str]
    endings: tuple[str, ...]
    object_first: bool = False


def word_lists(threats: str, objects: str, targets: str, negations: str, reports: str, endings: str, object_first: bool = False) -> WordLists:
    return WordLists(*(frozenset(x.split()) for x in (threats, objects, targets, negations, reports)), tuple(endings.split()), object_first)


#: Fixed word lists of the grammar; more languages are given to learn_grammar().
WORD_LISTS = {
    "en": word_lists("kill hurt destroy murder beat stab shoot burn crush strangle", "you him her them", "your yours he she they his hers their u ur", "not no never nor neither", "said says wrote quoted claimed alleged called told", "s es ish y ly er ers"),
    "de": word_lists("töten umbringen erschießen erstechen verprügeln", "dich euch ihn sie", "du ihr er dein deine euer", "nicht kein keine keinen nie niemals", "sagte sagt schrieb behauptete zitierte", "e en er es n s", True),
    "fr": word_lists("tuer frapper étrangler brûler", "te vous le la les", "tu toi il elle ils votre ton ta", "pas jamais ni aucun", "dit disait écrit affirmait", "s e es x", True),
    "es": word_lists("matar golpear quemar estrangular", "te le la lo los os", "tú usted ustedes él ella tu su", "no nunca jamás ni", "dijo dice escribió afirmó", "s es a o as os", True),
}
NEGATION_REACH, OBJECT_REACH = 3, 2
#: Letters that a word must have before an ending.
STEM = 4


@dataclass(frozen=True)
class Context:
    """What context does: the share of a hit's weight that negation and reported speech take away, what a target adds, and what a threat is
    worth. These are the values where no label tells otherwise."""

    negated: float = 1.0
    reported: float = 1.0
    targeted: float = 1.0
    threat: float = 5.0


#: How many labelled texts the values above count for.
PRIOR_TEXTS = 8
#: Insult weights are rounded to this step, so that the alphabet stays small.
STEP = 0.25
#: Labelled training rows that the lexicon and the calibration are learned from, at most about so many.
SAMPLE_ROWS = 20_000
#: Lengths of word beginnings that can be entries.
PREFIXES = range(4, 9)
MIN_SUPPORT, MIN_ODDS = 5, 3.0
#: Distinct words, each with support of its own, that make their common beginning an entry.
BEARERS = 5
#: Parts of the sample; each is calibrated on with entries that the others gave.
FOLDS = 4
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CUT = 0.7

ANY, OTHER, HIT, MENACE, TARGET, NEGATION, REPORT = "any", "other", "hit", "menace", "target", "negation", "report"
#: A threat whose object follows, one whose object goes before, and an object.
THREAT, THREAT_LATE, OBJECT = "threat", "threat-late", "object"
#: One arc: what is written, its weight, the next state.
Arc = tuple[str, float, str]


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] are the moves; a symbol that a state doesn't name takes its ANY arcs, which copy it."""

    start: str
    finals: frozenset[str]
    arcs: dict[str, dict[str, tuple[Arc, ...]]]

    def moves(self, state: str, symbol: str) -> list[Arc]:
        here = self.arcs[state]
        if symbol in here:
            return list(here[symbol])
        return [(symbol if out == ANY else out, w, to) for out, w, to in here.get(ANY, ())]

    def best(self, symbols: Iterable[str]) -> float:
        """The greatest weight of an accepting path; -inf where there is none."""
        reached = {self.start: 0.0}
        for s in symbols:
            after: dict[str, float] = {}
            for state, total in reached.items():
                for _, w, to in self.moves(state, s):
                    if total + w > after.get(to, -math.inf):
                        after[to] = total + w
            reached = after
        return max((v for q, v in reached.items() if q in self.finals), default=-math.inf)


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that reads what first reads and writes what second writes for what first writes."""
    alphabet = list(alphabet)
    name = lambda a, b: f"{a}+{b}"
    arcs: dict[str, dict[str, tuple[Arc, ...]]] = {}
    finals, todo, seen = set(), [(first.start, second.start)], {(first.start, second.start)}
    while todo:
        a, b = todo.pop()
        if a in first.finals and b in second.finals:
            finals.add(name(a, b))
        own: dict[str, tuple[Arc, ...]] = {}
        for s in alphabet:
            found = []
            for mid, w1, to_a in first.moves(a, s):
                for out, w2, to_b in second.moves(b, mid):
                    found.append((out, w1 + w2, name(to_a, to_b)))
                    if (to_a, to_b) not in seen:
                        seen.add((to_a, to_b))
                        todo.append((to_a, to_b))
            own[s] = tuple(found)
        arcs[name(a, b)] = own
    return Transducer(name(first.start, second.start), frozenset(finals), arcs)


def insult_symbol(weight: float) -> str:
    return f"insult{max(1, round(weight / STEP))}"


def insults(levels: Iterable[str]) -> Transducer:
    """Writes HIT for an insult, with its weight, or passes it over."""
    arcs = {s: ((HIT, int(s.removeprefix("insult")) * STEP, "q"), (OTHER, 0.0, "q")) for s in levels}
    return Transducer("q", frozenset("q"), {"q": {ANY: ((ANY, 0.0, "q"),), **arcs}})


def threats(worth: float = Context.threat, reach: int = OBJECT_REACH) -> Transducer:
    """Writes MENACE for a threat with an object within reach, on the side where it belongs, and TARGET for objects.

    A state says how many words ago an object may have stood for a late threat (had), and how many words are left for the
    object that a taken threat owes (due)."""
    name = lambda had, due: f"{had}.{due}"
    arcs: dict[str, dict[str, tuple[Arc, ...]]] = {}
    for had in range(reach + 1):
        for due in range(reach + 1):
            on = name(max(0, had - 1), due - 1) if due > 1 else name(max(0, had - 1), 0) if due == 0 else None
            own: dict[str, tuple[Arc, ...]] = {OBJECT: ((TARGET, 0.0, name(reach, 0)),)}
            own[ANY] = ((ANY, 0.0, on),) if on else ()
            free = ((OTHER, 0.0, on),) if on else ()
            own[THREAT] = free + (((MENACE, worth, name(max(0, had - 1), reach)),) if not due else ())
            own[THREAT_LATE] = free + (((MENACE, worth, on),) if had and on else ())
            arcs[name(had, due)] = own
    return Transducer(name(0, 0), frozenset(name(had, 0) for had in range(reach + 1)), arcs)


def targets(adds: float = Context.targeted) -> Transducer:
    """A hit gains by a target in its clause: a path may owe one, but not at the end. A menace has its own."""
    stay = lambda q: {ANY: ((ANY, 0.0, q),), HIT: ((HIT, adds, q),), MENACE: ((HIT, 0.0, q),)}
    return Transducer(
        "free",
        frozenset({"free", "named"}),
        {
            "free": {ANY: ((ANY, 0.0, "free"),), TARGET: ((TARGET, 0.0, "named"),), HIT: ((HIT, 0.0, "free"), (HIT, adds, "owing")), MENACE: ((HIT, 0.0, "free"),)},
            "owing": {**stay("owing"), TARGET: ((TARGET, 0.0, "named"),)},
            "named": stay("named"),
        },
    )


def negations(loss: float, reach: int = NEGATION_REACH) -> Transducer:
    """Hits among the next words after a negation lose weight."""
    arcs: dict[str, dict[str, tuple[Arc, ...]]] = {"0": {ANY: ((ANY, 0.0, "0"),), NEGATION: ((NEGATION, 0.0, str(reach)),)}}
    for left in range(1, reach + 1):
        down = str(left - 1)
        arcs[str(left)] = {ANY: ((ANY, 0.0, down),), HIT: ((HIT, -loss, down),), NEGATION: ((NEGATION, 0.0, str(reach)),)}
    return Transducer("0", frozenset(arcs), arcs)


def reports(loss: float) -> Transducer:
    """Hits after a word of reported speech lose weight."""
    return Transducer(
        "own",
        frozenset({"own", "told"}),
        {"own": {ANY: ((ANY, 0.0, "own"),), REPORT: ((REPORT, 0.0, "told"),)}, "told": {ANY: ((ANY, 0.0, "told"),), HIT: ((HIT, -loss, "told"),)}},
    )


def steps_of(levels: Iterable[str], context: Context = Context()) -> list[Transducer]:
    """The five transducers. A loss is a share of the most that a hit can be worth, so that a whole one leaves nothing of any."""
    levels = sorted(set(levels))
    most = max([context.threat, *(int(x.removeprefix("insult")) * STEP for x in levels)]) + context.targeted
    return [insults(levels), threats(context.threat), targets(context.targeted), negations(context.negated * most), reports(context.reported * most)]


def grammar_of(levels: Iterable[str], context: Context = Context()) -> Transducer:
    """The five transducers as one."""
    alphabet = [OTHER, THREAT, THREAT_LATE, OBJECT, TARGET, NEGATION, REPORT, *sorted(set(levels))]
    whole, *rest = steps_of(levels, context)
    for step in rest:
        whole = compose(whole, step, alphabet)
    return whole


def tokens(text: str) -> list[str]:
    return WORD.findall(text)


def plain(text: str) -> str:
    return text.lower().replace("’", "'")


@dataclass
class Grammar:
    """Insult entries (whole words, and beginnings that end in *) with weights; what context does; coefficients of the calibration."""

    entries: dict[str, float]
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    context: Context = Context()
    lists: tuple[WordLists, ...] = tuple(WORD_LISTS.values())
    _machine: Transducer | None = field(default=None, repr=False)
    _classes: dict[str, str] = field(default_factory=dict, repr=False)
    _hot: set[str] = field(default_factory=set, repr=False)
    _tables: tuple | None = field(default=None, repr=False)

    #: Words whose class is remembered; forgotten together beyond that.
    KNOWN_WORDS = 200_000

    def tables(self) -> tuple[dict[int, frozenset[str]], dict[int, dict[str, float]], dict[str, str]]:
        """Endings by length, beginnings by length, and the class of each listed word: the first kind that any language has it as."""
        if self._tables is None:
            endings, begins, kinds = {}, {}, {}
            for e in {e for w in self.lists for e in w.endings}:
                endings[len(e)] = endings.get(len(e), frozenset()) | {e}
            for entry, weight in self.entries.items():
                if entry.endswith("*"):
                    begins.setdefault(len(entry) - 1, {})[entry[:-1]] = weight
            for kind, name in (("targets", TARGET), ("objects", OBJECT), ("reports", REPORT), ("negations", NEGATION)):
                kinds.update((x, name) for w in self.lists for x in getattr(w, kind))
            for late in (False, True):
                kinds.update((x, THREAT_LATE if late else THREAT) for w in self.lists if w.object_first == late for x in w.threats)
            self._tables = endings, begins, kinds
        return self._tables

    def insult(self, word: str) -> float:
        """The greatest weight of an entry that fits the word, itself, without an ending or by its beginning; 0 if none does."""
        endings, begins, _ = self.tables()
        best = self.entries.get(word, 0.0)
        for n, some in endings.items():
            if len(word) - n >= STEM and word[-n:] in some:
                best = max(best, self.entries.get(word[:-n], 0.0))
        for n, some in begins.items():
            if n < len(word):
                best = max(best, some.get(word[:n], 0.0))
        return best

    def classify(self, word: str) -> str:
        known = self._classes.get(word)
        if known is None:
            if w := self.insult(word):
                known = insult_symbol(w)
            else:
                known = self.tables()[2].get(word) or (NEGATION if word.endswith("n't") else OTHER)
            if len(self._classes) >= self.KNOWN_WORDS:
                self._classes.clear()
                self._hot.clear()
            self._classes[word] = known
            if known.startswith(("insult", THREAT)):
                self._hot.add(word)
        return known

    def machine(self) -> Transducer:
        if self._machine is None:
            self._machine = grammar_of({insult_symbol(w) for w in self.entries.values()}, self.context)
        return self._machine

    def clause(self, words: list[str]) -> float:
        return self.machine().best(map(self.classify, words))

    def clauses(self, text: str | None) -> tuple[list[list[str]], int]:
        """The clauses with a possible match, as classes, and the number of all words."""
        low = plain(text or "")
        words = tokens(low)
        distinct = set(words)
        for w in distinct.difference(self._classes):
            self.classify(w)
        bites = distinct & self._hot if self._classes.keys() >= distinct else {w for w in distinct if self.classify(w).startswith(("insult", THREAT))}
        found = []
        if bites:
            for part in CLAUSE.split(low):
                own = tokens(part)
                if not bites.isdisjoint(own):
                    found.append([self.classify(w) for w in own])
        return found, len(words)

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Of a text's clauses the greatest weight and the sum; how many words the text has."""
        found, words = self.clauses(text)
        weights = [self.machine().best(c) for c in found]
        return max(weights, default=0.0), float(sum(weights)), words

    def setting(self, text: str | None) -> int:
        """Where the text's matches stand: the SETTINGS that holds for all of them, the first that fits."""
        found, _ = self.clauses(text)
        whole = Context(0.0, 0.0, 0.0, self.context.threat)
        levels = {insult_symbol(w) for w in self.entries.values()}
        if not hasattr(self, "_probes"):
            made = lambda c: grammar_of(levels, c)
            self._probes = made(whole), made(replace(whole, negated=1.0)), made(replace(whole, reported=1.0))
        bare, negated, reported = ([m.best(c) for c in found] for m in self._probes)
        if not any(bare):
            return SETTINGS.index("none")
        if not any(s.startswith("insult") for c in found for s in c):
            return SETTINGS.index("threat")
        if not any(negated):
            return SETTINGS.index("negated")
        if not any(reported):
            return SETTINGS.index("reported")
        named = any(s in (TARGET, OBJECT) for c in found for s in c)
        return SETTINGS.index("targeted" if named else "bare")

    def score(self, text: str | None) -> float:
        z = float(np.dot(_inputs(*(np.array([v], float) for v in self.features(text)))[0], self.coefficients))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


SETTINGS = ("none", "bare", "targeted", "negated", "reported", "threat")


def learn_context(counts: dict[str, tuple[int, int]], prior: Context = Context()) -> Context:
    """What context does, from the numbers of toxic and other texts in each of SETTINGS.

    A setting's weight is the logarithm of its odds against those of texts without a match. Each prior value counts for PRIOR_TEXTS
    texts: negated and reported insults are taken for no insults until labels say that they are."""
    odds = lambda kind, more=(0.0, 0.0): math.log((counts.get(kind, (0, 0))[0] + 0.5 + more[0]) / (counts.get(kind, (0, 0))[1] + 0.5 + more[1]))
    rows = lambda kind: sum(counts.get(kind, (0, 0)))
    none = odds("none")
    said = tuple(sum(counts.get(k, (0, 0))[i] for k in ("bare", "targeted")) for i in (0, 1))
    worth = math.log((said[0] + 0.5) / (said[1] + 0.5)) - none
    rate = 1 / (1 + math.exp(-none))

    def loss(kind: str, share: float) -> float:
        if worth <= 0:
            return share
        expected = 1 / (1 + math.exp(-(none + (1 - share) * worth))) if share < 1 else rate
        found = odds(kind, (PRIOR_TEXTS * expected, PRIOR_TEXTS * (1 - expected))) - none
        return min(1.0, max(0.0, 1 - found / worth)) if rows(kind) else share

    blend = lambda kind, value, seen: (PRIOR_TEXTS * value + rows(kind) * max(0.0, seen)) / (PRIOR_TEXTS + rows(kind))
    both = rows("bare") and rows("targeted")
    return Context(
        loss("negated", prior.negated), loss("reported", prior.reported),
        blend("targeted", prior.targeted, odds("targeted") - odds("bare")) if both else prior.targeted,
        blend("threat", prior.threat, odds("threat") - none) if rows("threat") else prior.threat,
    )


def _inputs(top: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Inputs of the calibration: strongest clause, all clauses, and length, as long texts match more by chance."""
    return np.column_stack([top, np.log1p(total), -np.log1p(words) * (total > 0), np.ones(len(top))])


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a little ridge; coefficients below 0 are left out, but for the offset."""
    use = list(range(x.shape[1]))
    while True:
        b = np.zeros(len(use))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ b, -30, 30)))
            h = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + 0.05 * np.eye(len(use))
            b += np.linalg.solve(h, x[:, use].T @ (y - p) - 0.05 * b)
        bad = [u for u, v in zip(use[:-1], b, strict=False) if v < 0]
        if not bad:
            out = np.zeros(x.shape[1])
            out[use] = b
            return tuple(float(v) for v in out)
        use = [u for u in use if u not in bad]


def entries_of(text: str) -> set[str]:
    """What of a text could become an entry: its words."""
    return set(tokens(plain(text)))


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, toxic, text) -> (fold, entry, pos, neg): in how many of a fold's texts an entry stands, by their labels."""
    for batch in batches:
        counts: Counter[tuple[int, str, int]] = Counter()
        for fold, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts.update((fold, e, toxic) for e in entries_of(text))
        keys = sorted({(fold, e) for fold, e, _ in counts})
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([counts[*k, t] for k in keys], pa.int64()) for t in (1, 0))],
            names=["fold", "entry", "pos", "neg"],
        )


def _measured(grammar: Grammar, broadcast_of, settings: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(..., text) -> (..., top, total, words, setting)."""
    shared = broadcast_of(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            texts, out = batch.column(batch.num_columns - 1), []
            for at in range(0, len(batch), 256):  # as Python strings, few at a time
                out += [(*g.features(t), g.setting(t) if settings else 0) for t in texts.slice(at, 256).to_pylist()]
            columns = [pa.array([f[i] for f in out], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "top", "total", "words", "setting"])

    return run


def learn_entries(counted: DataFrame, sizes: dict[int, tuple[int, int]], without: int | None = None) -> dict[str, float]:
    """Entries and weights from counts (fold, entry, pos, neg) and the folds' numbers of texts, one fold left out.

    A word is an entry if it stands in MIN_SUPPORT toxic texts or more, four times as many as others, and the logarithm of its
    smoothed odds against the sample's is MIN_ODDS or more, which is its weight. A beginning is one by the same measure of all
    words that have it, if BEARERS distinct words or more do so on their own account: each stands in at least two toxic texts, four times as many
    as others. One insult and its inflections are too few for that. What the driver gets is bounded by the sample."""
    pos, neg = (sum(n[i] for fold, n in sizes.items() if fold != without) for i in (0, 1))
    used = counted if without is None else counted.filter(F.col("fold") != without)
    sums = used.groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    begins = F.filter(F.array(*[F.when(F.length("entry") > k, F.substring("entry", 1, k)) for k in PREFIXES]), lambda b: b.isNotNull())
    bears = (F.col("pos") >= 2) & (F.col("pos") >= 4 * F.col("neg"))
    shared = sums.select(F.explode(begins).alias("begin"), "pos", "neg", bears.alias("bears")).groupBy("begin").agg(F.count(F.when(F.col("bears"), 1)).alias("n"), F.least(F.lit(pos), F.sum("pos")).alias("pos"), F.sum("neg").alias("neg"))
    all_ = sums.unionByName(shared.filter(F.col("n") >= BEARERS).select(F.concat("begin", F.lit("*")).alias("entry"), "pos", "neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    strong = all_.withColumn("odds", odds).filter((F.col("pos") >= MIN_SUPPORT) & (F.col("odds") >= MIN_ODDS) & (F.col("pos") >= 4 * F.col("neg")))
    return {r["entry"]: r["odds"] for r in strong.collect()}


def learn_grammar(docs: DataFrame, labels: DataFrame, lists: dict[str, WordLists] = WORD_LISTS) -> Grammar:
    """Insult entries, what context does, and calibration, from labelled rows whose crc32(id) mod 3 is not 1.

    At most about SAMPLE_ROWS rows are used, chosen by a hash of the id; equal texts count once, toxic if any of
    their rows is. Context and calibration see each text through entries learned from the other folds, so that they
    aren't misled by entries that only fit the text itself. Without toxic training rows there are no entries and every
    score is the base rate's."""
    spark = docs.sparkSession
    ship(spark)
    labelled = labels.filter((id_crc(F.col("doc_id")) % 3 != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labelled.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1_000_003)) / 1_000_003.0
    chosen = labelled.filter(drawn < min(1.0, SAMPLE_ROWS / max(1, n)))
    rows = join_checked(docs.select("doc_id", "text"), chosen, "doc_id").filter(F.col("text").isNotNull())
    rows = stash(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select((F.crc32("text") % FOLDS).cast("int").alias("fold"), "toxic", "text"), "toxicity-sample")
    sizes = {r["fold"]: (r["pos"], r["neg"]) for r in rows.groupBy("fold").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).collect()}
    counted = stash(rows.mapInArrow(_count_entries, "fold int, entry string, pos long, neg long").groupBy("fold", "entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxicity-entries")
    words = tuple(lists.values())
    grammar = Grammar(learn_entries(counted, sizes), lists=words)

    def through_others(context: Context, settings: bool) -> pa.Table | None:
        seen = []
        for fold in sizes:
            apart = Grammar(entries[fold], context=context, lists=words)
            run = _measured(apart, spark.sparkContext.broadcast, settings)
            seen.append(rows.filter(F.col("fold") == fold).select("toxic", "text").mapInArrow(run, "toxic int, top double, total double, words long, setting int").toArrow())
        return pa.concat_tables(seen) if seen else None

    entries = {fold: learn_entries(counted, sizes, without=fold) for fold in sizes}
    table = through_others(Context(), True)
    y = np.asarray(table["toxic"], float) if table is not None else np.zeros(0)
    if not grammar.entries:
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        grammar.coefficients = (0.0, 0.0, 0.0, math.log(rate / (1 - rate)))
        return grammar
    where = np.asarray(table["setting"])
    grammar.context = learn_context({name: (int(y[where == i].sum()), int((1 - y[where == i]).sum())) for i, name in enumerate(SETTINGS)})
    table = through_others(grammar.context, False)
    y = np.asarray(table["toxic"], float)
    grammar.coefficients = calibrated(_inputs(*(np.asarray(table[c], float) for c in ("top", "total", "words"))), y)
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, top, total (weights of its clauses), words.

    Reads doc_id and text; other columns don't matter, and nothing but the text enters a score. A null or
    empty text scores as one without matches. A null id is not held out. Repeated rows score alike. Very long texts
    are read whole, clause by clause. Empty input gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(id_crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    run = _measured(replace(grammar, _machine=None, _classes={}, _hot=set(), _tables=None), spark.sparkContext.broadcast)
    weighed = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, top double, total double, words long, setting int")
    a, b, c, d = grammar.coefficients
    z = F.col("top") * a + F.log1p("total") * b - F.when(F.col("total") > 0, F.log1p("words")).otherwise(0.0) * c + d
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return weighed.select("doc_id", "held_out", score.alias("score"), F.when(score >= CUT, 1).otherwise(0).alias("predicted"), "top", "total", "words")
