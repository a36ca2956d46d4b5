"""The whole pipeline against plain versions of its stages."""

import random
import re

import corpus_pipeline
import public_tokenizers
import test_decontam
import test_packing
import test_pii
import test_simhash
from tokenizers import Tokenizer

from runledger.llm import decontam, pii, quality, simhash
from runledger.session import scratch_path


def redacted(text):
    listed = test_pii.brute(text)
    spans = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in listed.split(",") if s)]
    out, at = "", 0
    for a, kind, b in sorted(spans):
        if b > at:
            out, at = out + text[at:a] + f"[{pii.KINDS[kind].upper()}]", b
    return out + text[at:]


def test_pipeline(spark):
    rng = random.Random(8)
    words = ["stone", "river", "water", "cloud", "field", "north", "green", "light"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    item = say(15)
    texts = [say(rng.randint(20, 60)) for _ in range(50)]
    texts += [texts[0], texts[1] + " ", texts[2].upper(), "!!$$ %% " * 40, "&&## ** " * 30, *(say(n) + " " + item + " " + say(20) for n in (5, 9, 14, 30)), f"{say(30)} 10.0.0.{rng.randint(1, 9)} {say(9)}",
              f"{say(20)} me@here.org {say(9)}", say(2000),
              f"{say(30)} +1 (202) 555-0123.bob@mail.com {say(9)}", f"{say(20)} <|endoftext|> {say(20)}"]
    bad = {i for i, t in enumerate(texts) if t[0] in "!&"}
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    sf = scratch_path(spark, "fixture")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score_documents(frame, labels).collect()}
    rows = [(d, t) for d, t, *_ in docs if scores[d] >= quality.THRESHOLD]
    rows = [(d, t) for d, t in rows if (d, d) in {(x, c) for x, _, c in test_simhash.brute(rows)}]
    hit = {d for d, n, h, _ in test_decontam.brute(rows, [(1, item)]) if h and 20 * h >= n}
    rows = [(d, redacted(t)) for d, t in rows if d not in hit]
    assert len(rows) < len(texts) - 4 and any("[IP]" in t for _, t in rows) and hit

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, sf).collect()
    test_packing.check(tokenizer, rows, packed, 1024)
    assert {p.doc_id for p in packed} == {d for d, _ in rows}


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == before, name
    assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", " ".join(r.text or "" for r in docs.collect()))


def test_stages_with_clashing_columns_and_repeated_ids(spark):
    """Two orders of the same rows give the same documents, with columns called like the stages' own."""
    say = lambda n, word="stone": " ".join(f"{word}{i}" for i in range(n))
    rows = [(1, say(30)), (1, say(40, "river")), (1, "me@here.org " + say(20, "cloud")), (2, say(30)), (3, None), (3, ""), (None, say(9, "n")),
            (4, say(25, "field") + " 10.0.0.1"), (5, say(50, "bench")), (5, say(30, "light"))]
    schema = "doc_id long, text string, _id long, _key long, _spans int, root string, key string, n_chars long, count int"
    rows = [(d, t, 1, 2, 3, "r", "k", len(t or ""), 5) for d, t in rows]
    benchmark = spark.createDataFrame([(1, say(50, "bench"))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")

    def stages(order):
        docs = spark.createDataFrame(order, schema).repartition(3)
        found = []
        for stage in (lambda d: quality.keep_good(d, labels), simhash.keep_one, lambda d: decontam.drop_contaminated(d, benchmark), pii.redact):
            docs = stage(docs)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            found.append(sorted(map(str, docs.collect())))
        return found
    first = stages(rows)
    assert first == stages(rows[::-1]) and "me@here.org" not in str(first[-1])
