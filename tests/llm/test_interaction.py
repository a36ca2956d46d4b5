"""Filter orders against a plain simulation of every order."""

import random
import re
from itertools import permutations

import pytest

from runledger.llm import interaction


def failures(docs):
    firsts = {}
    for d, t, _ in docs:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    out = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
             "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
             "E": d is not None and firsts[t] < d}
        out.append((d, lang or "", {k for k, v in f.items() if v}))
    return out


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    failed, rows, shapley = failures(docs), {}, {}
    for part in {p for _, p, _ in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in failed if x[1] == part]
            everyone = left
            for step, letter in enumerate(order, 1):
                out = [x for x in left if letter in x[2]]
                left = [x for x in left if letter not in x[2]]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(out)
                rows[part, order, step] = [
                    len(left), len(out), sum(letter in x[2] for x in everyone) - len(out), sum({letter} == x[2] for x in everyone),
                    sum(x[0] in good and x[0] is not None for x in out), sum(x[0] in toxic and x[0] is not None for x in out)]
    return sorted((*key, *counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in rows.items())


def audited(spark, docs, labels, **options):
    d = spark.createDataFrame([(*row, 1, "x") for row in docs], "doc_id long, text string, lang string, quality int, h string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in interaction.audit(d, marks, **options).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def tables():
    rng = random.Random(3)
    texts = [None, "", " \n", "Word", "A" * 300, "a#b", "  é É", "x " * 5000, "UP " * 201]
    texts += [" ".join(rng.choice(["a", "B", "c|", *(f"w{i}" for i in range(rng.choice([2, 400])))]) for _ in range(rng.choice([5, 199, 200, 260])))
              for _ in range(30)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(1000), 120)]
    docs += [(2000 + i, "the same everywhere", "en") for i in range(100)] + [(7, "z", "en"), (7, "z", "en"), (7, "y", "fr"), (8, "z", "en")]
    docs += [(None, "z", "en"), (None, "", "en"), (None, "only here", None), (-5, "the same everywhere", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(1000), 500)]
    labels += [(7, 1, 0), (7, 0, 1), (None, 1, 1), (2050, 1, 0), (2051, None, None)]
    return docs, labels


@pytest.mark.parametrize("options", [{}, {"limit": 0, "salts": 5}])
def test_against_every_order(spark, options):
    docs, labels = tables()
    assert audited(spark, docs, labels, **options) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    docs = [(1, "x", "en"), (2, "x", "en")]
    assert audited(spark, docs, []) == brute(docs, [])
