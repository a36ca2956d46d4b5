"""Base spans against the plain expressions, the pattern graph, and redaction."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from runledger.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(m.start(), n, m.end()) for n, (k, e) in enumerate(PLAIN.items())
             for m in re.finditer(e, text or "") if valid(k, m[0])]
    return ",".join(f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in sorted(found))


def base(spark, rows):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, base int")
    return sorted(((r.doc_id, r.b) for r in pii.find(docs).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()), key=str)


def with_check_digit(digits):
    return next(digits + str(n) for n in range(10) if luhn(digits + str(n)))


def test_base_spans(spark):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "_", "%", "+", "+1", " ", "  ", "é", "😀", "\n", "1", "22", "333", "255", "256",
             "000255", ".7", "1.2.3.4", "(988) ", "555-2485", "x@y.zz", with_check_digit("400000000000000"),
             with_check_digit("4111 1111 1111 111"[:18].replace(" ", "")), "4111 1111 1111 1111", "4111-1111-1111-1111 "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(3000)]
    rows += [(-1, None), (-2, ""), (None, "me@here.org"), (-3, "a@b.c_d@e.f.g"), (-4, "1.2.3.4.5.6.7.8"), (-4, "1.2.3.4.5.6.7.8"),
             (-5, "x" * 20_000), (-6, "9 " * 60_000), (-7, "a." * 5_000 + "@b" + ".c" * 50_000), (-8, "+1" + "(" * 50_000 + "234567890"),
             (-9, ("q@w.er " * 3000))]
    assert base(spark, rows) == sorted(((d, brute(t)) for d, t in rows), key=str)


def test_query_counts_by_kind(spark, tmp_path):
    texts = ["me@here.org and you@there.org", "10.0.0.1 then +1 (202) 555-0123", "4111 1111 1111 1111", "10.0.0.1 a@b.cd 10.0.0.2 e@f.gh 1.2.3.4", None, "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op1_pii(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for doc_id, text in enumerate(texts):
        listed = brute(text)
        row = found[doc_id]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [f",{listed}".count(f",{k}:") for k in pii.KINDS]


def test_empty(spark):
    assert base(spark, []) == []


def test_contexts_discover_new_shapes(spark):
    rows = [(i, f"please phone desk +1 (555) 010-{i:04d} today ok") for i in range(6)]
    rows += [(50, "please phone desk 0555/0101234 today ok"), (51, "built in 20240131 by hand"), (52, "room 12345")]
    found = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert found[50] == "phone:18:30" and found[51] == "" and found[52] == ""
    assert found[0] == brute(rows[0][1])


def graph_by_hand(links, rounds=3, support=3, least=0.8):
    seeds = {(v, k) for _, v, k in links if k is not None}
    pairs = {(p, v) for p, v, _ in links}
    known = {s: 1.0 for s in seeds}
    found = {}
    for _ in range(rounds):
        conf = {}
        for p in {p for p, _ in pairs}:
            values = {v for q, v in pairs if q == p}
            for kind in {k for _, k in known}:
                hits = [known[v, kind] for v in values if (v, kind) in known]
                if len(hits) >= support and sum(hits) / len(values) >= least:
                    conf[p, kind] = sum(hits) / len(values)
        found = {}
        for p, v in pairs:
            for (q, kind), c in conf.items():
                if q == p and v not in {s for s, _ in seeds}:
                    found[v, kind] = 1 - (1 - found.get((v, kind), 0.0)) * (1 - min(c, 0.99))
        known = {**{s: 1.0 for s in seeds}, **found}
    best = {}
    for (v, k), t in found.items():
        if t >= least and (v not in best or (t, -k) > (best[v][1], -best[v][0])):
            best[v] = (k, t)
    return {v: (k, round(t, 9)) for v, (k, t) in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_graph_scores(spark, seed):
    rng = random.Random(seed)
    kind_of = {f"s{i}": rng.randrange(4) for i in range(40)}
    links = set()
    for p in range(25):
        favourite = rng.randrange(4)
        for v, k in kind_of.items():
            if rng.random() < (0.5 if k == favourite else 0.02):
                links.add((f"p{p}", v, k))
        for u in range(12):
            if rng.random() < 0.08:
                links.add((f"p{p}", f"u{u}", None))
    rows = pii.score_graph(spark.createDataFrame(sorted(links, key=str), "pattern string, value string, kind int")).collect()
    assert {r.value: (r.kind, round(r.trust, 9)) for r in rows} == graph_by_hand(links)


def test_redact(spark):
    docs = spark.createDataFrame(
        [(1, "à me@here.org, 10.0.0.1!", 24, "x"), (2, None, 0, "y"), (3, "clean", 5, "z"), (None, "1.2.3.4", 7, "n"),
         (3, "mail a@b.cd", 11, "z")],
        "doc_id long, text string, n_chars long, base string")
    rows = pii.redact(docs)
    assert rows.columns == docs.columns
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        (1, "à [EMAIL], [IP]!", 16, "x"), (2, None, 0, "y"), (3, "clean", 5, "z"), (None, "[IP]", 4, "n"), (3, "mail [EMAIL]", 12, "z")], key=str)


def test_redact_covers_overlapping_spans(spark):
    rows = [(1, "call +1 (202) 555-0123.bob@mail.com now", "call [PHONE][EMAIL] now"),
            (2, "at 10.0.0.4111 x", None), (3, "1.2.3.4 and me@a.bc", "[IP] and [EMAIL]"),
            (4, "+1 202 555 0123@a.bc", "[PHONE][EMAIL]")]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for doc_id, text, wanted in rows:
        if wanted is not None:
            assert clean[doc_id] == wanted
        gone = {i for s in spans[doc_id] for i in range(s["start"], s["end"])}
        left = "".join(c for i, c in enumerate(text) if i not in gone)
        assert re.sub(r"\[[A-Z]+\]", "", clean[doc_id]) == left
