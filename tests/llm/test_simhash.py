"""SimHash linking against all pairs on small tables."""

import random

import pytest
import xxhash

from runledger.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string"


def brute(rows):
    prints = []
    for doc_id, text in rows:
        data = (text or "").encode().lower()
        words = data.split()
        grams = ([b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
                 if len(words) >= 3 else [b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        value = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
        prints.append((doc_id, value))
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (da, a) in enumerate(prints):
        for j, (db, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3 or (da is not None and da == db):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(doc_id)
    lowest = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, f"{v:016x}", lowest[find(i)]) for i, (d, v) in enumerate(prints)), key=str)


def result(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], schema)
    found = simhash.near_duplicates(docs)
    return sorted(((r.doc_id, f"{r.fingerprint % 2**64:016x}", r.component_id) for r in found.collect()), key=str)


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    base = [[rng.choice(words) for _ in range(rng.randint(40, 400))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 3, " ".join(text)))
    return rows


def test_against_all_pairs(spark):
    rows = corpus(120)
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None), (7, ""), (1, " \n\t"), (9, "One two"), (2, "ONE two"), (None, "one TWO"),
            (None, "alone here"), (4, "one"), (4, "entirely other words here"), (4, "one"),
            (11, "é É   x"), (12, "word " * 40000), (13, "word " * 40001)]
    assert result(spark, rows) == brute(rows)


def test_empty(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_links_keep_components_of_a_dense_group(spark, bits):
    """A group with thousands of near fingerprints, many of which share a segment."""
    rng = random.Random(bits)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(700)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), bits).collect()
    assert all(((r.fa ^ r.fb) % 2**64).bit_count() <= bits for r in found)

    def groups(pairs):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {v: find(v) for v in signed}
    wanted = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= bits]
    assert groups((r.fa, r.fb) for r in found) == groups(wanted)


def test_keep_one(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d", "x"), (1, "A b c  d", "y"), (1, "A b c  d", "y"), (8, "q r s t", "z"), (None, "q r s t", "n")],
        "doc_id long, text string, source string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "A b c  d", "y"), (8, "q r s t", "z"), (None, "q r s t", "n")]
