"""Winnowing against a plain loop over windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runledger.llm import textops, winnow

HASHER = textops.Hasher()


def plain(data, k, window):
    grams = [data[i:i + k] for i in range(max(len(data) - k + 1, 1))] if data else []
    hashes = []
    for g in grams:
        raw = np.frombuffer(g, np.uint8)
        hashes.append(int(HASHER.grams(HASHER.prefix(raw), len(raw))[0]) >> 32)
    chosen = []
    for i in range(max(len(hashes) - window + 1, 1) if hashes else 0):
        part = hashes[i:i + window]
        best = max(j for j, h in enumerate(part) if h == min(part)) + i
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [hashes[i] for i in chosen], chosen


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120), st.integers(1, 9), st.integers(1, 12))
def test_selection(data, k, window):
    hashes, positions = winnow.select(np.frombuffer(data, np.uint8), HASHER, k, window)
    assert (hashes.tolist(), positions.tolist()) == plain(data, k, window)


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=20, max_size=20), st.binary(max_size=60), st.binary(max_size=60))
def test_shared_run_is_always_found(run, a, b):
    """k + window - 1 equal bytes share a selected gram."""
    sets = [set(winnow.select(np.frombuffer(x + run + x, np.uint8), HASHER, 8, 13)[0].tolist()) for x in (a, b)]
    assert sets[0] & sets[1]


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for (doc_id, text), (_, nxt) in zip(order, order[1:] + order[:1]):
        text, nxt = text or "", nxt or ""
        n, cut = len(text), len(text) // 3
        edited = text[:n - cut] + nxt[:cut]
        prints = [plain(t.encode(), winnow.GRAM_BYTES, winnow.WINDOW)[0] for t in (text, edited, nxt)]

        def alike(a, b):
            return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        hexes = ["".join(f"{h:08x}" for h in p) for p in prints]
        out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), hexes[0], hexes[1],
                    alike(prints[0], prints[1]), alike(prints[0], prints[2])))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, range int")
    found = winnow.with_neighbours(docs, **options).drop("positions").collect()
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("size", [1, 7, 100])
def test_neighbours(spark, size):
    rng = random.Random(size)
    words = ["alpha", "béta", "γ", "delta", "日本", "x"]
    rows = [(i * 5 - 40, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(30)]
    rows[4] = (rows[4][0], None)
    rows[9] = (rows[9][0], "")
    rows += [(None, "without an id"), (7777, "long one " * 200)]
    assert run(spark, rows, rows_per_range=size) == brute(rows)


def test_repeated_rows_and_single(spark):
    same = [(4, "repeated text " * 20)] * 3 + [(9, "other " * 40)]
    assert run(spark, same, rows_per_range=2) == brute(same)
    assert run(spark, [(1, "only")]) == brute([(1, "only")])
    assert run(spark, []) == []


def test_equal_texts_have_equal_fingerprints(spark):
    docs = spark.createDataFrame([(1, "abc " * 50), (2, "abc " * 50), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in winnow.fingerprints(docs).collect()}
    assert rows[1].hashes == rows[2].hashes and rows[1].positions == rows[2].positions and rows[3].hashes == []
