"""The composed transducers against paths enumerated one by one, and what the grammar makes of clauses."""

import itertools
import random

import pytest

from threadloom.llm import toxicity as T

LEVELS = ["insult8", "insult20"]
CONTEXT = T.Context(0.6, 0.3, 1.0, 5.0)
STEPS = T.steps_of(LEVELS, CONTEXT)
ALPHABET = [T.OTHER, T.THREAT, T.THREAT_LATE, T.OBJECT, T.TARGET, T.NEGATION, T.REPORT, *LEVELS]


def outputs(machine, symbols):
    """Every accepted output string of a machine with the weight of its path, by plain recursion."""

    def walk(state, rest):
        if not rest:
            if state in machine.finals:
                yield (), 0.0
            return
        for out, w, to in machine.moves(state, rest[0]):
            for tail, more in walk(to, rest[1:]):
                yield (out, *tail), w + more

    return list(walk(machine.start, symbols))


def cascade(symbols):
    """The best weight when each transducer reads every output of the one before it."""
    paths = [(tuple(symbols), 0.0)]
    for machine in STEPS:
        paths = [(out, w + more) for read, w in paths for out, more in outputs(machine, read)]
    return max(w for _, w in paths)


def test_composition_equals_enumerated_paths():
    whole = T.grammar_of(LEVELS, CONTEXT)
    for n in (1, 2, 3):
        for s in itertools.product(ALPHABET, repeat=n):
            assert whole.best(s) == pytest.approx(cascade(s))
    rng = random.Random(4)
    for _ in range(60):
        s = [rng.choice(ALPHABET) for _ in range(rng.randint(4, 7))]
        assert whole.best(s) == pytest.approx(cascade(s))
        assert whole.best(s) == pytest.approx(max(w for _, w in outputs(whole, s)))


def test_clauses():
    g = T.Grammar({"idiot": 6.0, "scum*": 5.0})
    clause = lambda t: g.features(t)[0]
    assert clause("you are an idiot") > clause("what an idiot") > clause("he is not an idiot") == 0 == clause("the paper said idiot")
    assert clause("we kill time") == clause("kill the process if you see it") == clause("they beat their record") == 0 < clause("i will kill you")
    assert clause("you i will kill") == 0 < clause("je vais te tuer") == clause("ich werde dich bald töten")
    assert clause("scumbags all") == pytest.approx(5.0) and clause("idiots all") == pytest.approx(6.0) and clause("idiotic all") == 0
    assert clause("don’t call him scumbag") == 0 < clause("call him scumbag")
    assert g.features("an idiot. an idiot") == (6.0, 12.0, 4)
    assert g.features(None) == g.features("") == (0.0, 0.0, 0)
    half = T.Grammar({"idiot": 6.0}, context=T.Context(negated=0.5, reported=0.25))
    assert half.features("not an idiot")[0] == pytest.approx(6 - 3.5) and half.features("said idiot")[0] == pytest.approx(6 - 1.75)


def test_context_is_learned_from_labels():
    plain = {"none": (50, 950), "bare": (90, 1), "targeted": (90, 1)}
    assert T.learn_context(plain) == T.Context(targeted=T.learn_context(plain).targeted)
    toxic = T.learn_context({**plain, "negated": (60, 1), "reported": (1, 60), "threat": (40, 0)})
    assert toxic.negated < 0.4 and toxic.reported == 1.0 and toxic.threat > T.Context().threat
    harmless = T.learn_context({**plain, "negated": (2, 60), "threat": (1, 400)})
    assert harmless.negated > 0.9 and harmless.threat < 1.0
    assert T.learn_context({}) == T.Context()


def test_settings():
    g = T.Grammar({"idiot": 6.0})
    want = {"nothing here": "none", "what an idiot": "bare", "you idiot": "targeted", "not an idiot": "negated", "he said idiot": "reported", "i will kill you": "threat", "not an idiot. idiot": "bare"}
    assert {t: T.SETTINGS[g.setting(t)] for t in want} == want


def test_grammars_do_not_share_words():
    assert T.Grammar({"idiot": 6.0}).insult("idiot") == 6.0
    assert T.Grammar({"other": 2.0}).features("idiot")[0] == 0.0


def test_entries_are_words_and_real_beginnings():
    assert T.entries_of("Scumbag, so") == {"scumbag", "so"}


def test_a_beginning_needs_several_words_of_its_own(spark):
    rows = [(0, f"scum{x}", 3, 0) for x in ("bag", "ball", "face", "lord")] + [(1, "scumpot", 2, 0), (0, "seen", 9, 30), (0, "rare", 2, 0), (1, "idiot", 20, 1), (0, "trash", 9, 0), (0, "trashy", 9, 0), (1, "trasher", 9, 0), (0, "clown", 9, 0), (1, "clowness", 2, 0)]
    rows += [(0, f"some{x}", 3, 0) for x in "abcde"] + [(0, "something", 0, 30)]
    counted = spark.createDataFrame(rows, "fold int, entry string, pos long, neg long")
    sizes = {0: (30, 300), 1: (30, 300)}
    assert set(T.learn_entries(counted, sizes)) == {"scum*", "idiot", "trash", "trashy", "trasher", "clown"}
    assert set(T.learn_entries(counted, sizes, without=1)) == {"trash", "trashy", "clown"}


def test_ordinary_sentences_pass_and_insults_in_context_change_the_verdict(spark):
    rng = random.Random(5)
    bad, words = "idiot moron trash stupid".split(), [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (f". you {rng.choice(bad)} {rng.choice(words)} {rng.choice(bad)}." if i % 4 == 0 else ". you and them.")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    g = T.learn_grammar(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int"))
    assert set(g.entries) == set(bad)
    for text in (
        "We discussed more traditional clothing.", "The discussion in the morning covered more cloud training and model scumbling.", "They beat their record.",
        "Kill the process if you see your server hang.", "You are not an idiot.", "He said you are an idiot.",
    ):
        assert g.score(text) < T.CUT, text
    for text in ("You are an idiot.", "What stupid trash.", "You idiots!"):
        assert g.score(text) >= T.CUT, text
