"""Scores against plain counting and a walk with states and failure arcs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from runledger.llm import lm


def tokens(text):
    lowered = (text or "").encode().lower()
    return [*lowered.split(), "end"]


def brute(rows, order, strength):
    out, counts = [], [Counter() for _ in range(order + 1)]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    for (_, text), skip in zip(rows, held):
        words = ["begin", *tokens(text)]
        if not skip:
            for n in range(1, order + 1):
                for i in range(len(words) - n + 1):
                    counts[n][tuple(words[i:i + n])] += 1
    docs = counts[1].pop(("begin",), 0)
    total, distinct = sum(counts[1].values()), len(counts[1])
    counts[1]["begin",] = docs

    def arc(state, word):
        """Probability of a word from a state: its arc, or the failure arc and the shorter state's."""
        if not state:
            return (counts[1][word,] + 1) / (total + distinct + 1)
        lower = arc(state[1:], word)
        seen, c = counts[len(state)][state], counts[len(state) + 1][(*state, word)]
        return (c + strength * lower) / (seen + strength) if c else strength / (seen + strength) * lower
    for (doc_id, text), skip in zip(rows, held):
        state, score, base = ("begin",)[:order - 1], 0.0, 0.0
        words = tokens(text)
        for w in words:
            score += math.log10(arc(state, w))
            base += math.log10((counts[1][w,] + 1) / (total + distinct + 1))
            state = (*state, w)[-(order - 1):] if order > 1 else ()
        out.append((doc_id, skip, len(words), sum(counts[1][w,] > 0 for w in words), round(base, 6), round(score, 6), total))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_order int").repartition(3)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6), r.train_tokens)
                   for r in lm.score(docs, **options).collect()), key=str)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "x y", *(f"w{i}" for i in range(30))]
    return [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_a_walk(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_TOKENS", 300)
    monkeypatch.setattr(lm, "GRAMS_PER_BUCKET", 40)
    monkeypatch.setattr(lm, "WALK_TOKENS", 7)
    rows = corpus(150) + [(None, "the of the"), (3, "the the"), (3, "the the"), (500, None), (501, " \n"), (502, "w1 w2 " * 3000)]
    assert run(spark, rows, order=order, strength=1.5) == brute(rows, order, 1.5)


def test_nothing_to_train_on(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "some words here") for i in held]
    assert run(spark, rows) == brute(rows, lm.ORDER, lm.STRENGTH)
    assert run(spark, []) == []


def test_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, from a seen state."""
    rows = [(i, "a b a c") for i in range(9)]
    n, v = 5 * sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(9)), 4
    c = {"a": 2 * n / 5, "b": n / 5, "c": n / 5, "end": n / 5}
    arcs = {"b": n / 5, "c": n / 5}
    base = {w: (k + 1) / (n + v + 1) for w, k in c.items()} | {"?": 1 / (n + v + 1)}
    total = sum((arcs.get(w, 0) + lm.STRENGTH * p) / (c["a"] + lm.STRENGTH) for w, p in base.items())
    assert abs(total - 1) < 1e-12
    assert run(spark, rows) == brute(rows, lm.ORDER, lm.STRENGTH)


def test_long_words_that_sums_cannot_tell_apart(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    mirror = word.translate(str.maketrans("ab", "ba"))
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2)
    seen = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(seen, word), (held, mirror), (seen + 1000, word[:1024]), (held, mirror[:1024])]
    assert run(spark, rows) == brute(rows, lm.ORDER, lm.STRENGTH)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_states_and_arcs(order):
    """All states, word arcs and failure arcs of one segment against plain counting."""
    rng, strength = random.Random(order), 1.5
    texts = [[rng.randrange(5) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    held = [rng.random() < 0.3 for _ in texts]
    begin, end = 5, 6
    streams = [[begin, *t, end] for t in texts]
    segment = lm._Segment(list(range(40)), held, [len(t) + 1 for t in texts], np.arange(7, dtype=np.uint64) * 1000 + 17,
                          np.array([w for t in streams for w in t], np.uint32))
    counts, answers = [Counter() for _ in range(order + 1)], {}
    for n in range(1, order + 1):
        distinct, numbers, whole = segment.grams(n)
        answers[n] = np.bincount(numbers[whole & segment.training], minlength=len(distinct))
        for t, skip in zip(streams, held):
            if not skip:
                counts[n].update(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    total = sum(c for g, c in counts[1].items() if g != (begin,))
    distinct = len(counts[1]) - ((begin,) in counts[1])
    automaton = lm.Automaton(segment, answers, order, strength, total, distinct)
    # Which history each state number stands for, by the places of the stream.
    history, offset = {(): 0}, 1
    for n in range(1, order):
        _, numbers, whole = segment.grams(n)
        for i in np.flatnonzero(whole):
            gram = tuple(int(w) for w in segment.tokens[i - n + 1:i + 1])
            if counts[n][gram]:
                history[gram] = offset + int(numbers[i])
        offset += len(answers[n])

    def weight(state, word):
        if not state:
            return (counts[1][word,] + 1) / (total + distinct + 1)
        return (counts[len(state) + 1][(*state, word)] + strength * weight(state[1:], word)) / (counts[len(state)][state] + strength)

    def longest(state):
        while state not in history:
            state = state[1:]
        return history[state]
    arcs = {int(k): (float(p), int(t)) for k, p, t in zip(automaton.key, automaton.log_arc, automaton.target)}
    expected = {}
    for state, number in history.items():
        for word in range(7):
            if not state or counts[len(state) + 1][(*state, word)]:
                expected[number * 7 + word] = (math.log10(weight(state, word)), longest((*state, word)[-(order - 1):] if order > 1 else ()))
        if state:
            assert automaton.failure[number] == history[state[1:]]
            assert abs(automaton.log_failure[number] - math.log10(strength / (counts[len(state)][state] + strength))) < 1e-12
    assert arcs.keys() == expected.keys()
    assert all(arcs[k][1] == t and abs(arcs[k][0] - p) < 1e-12 for k, (p, t) in expected.items())
