"""Phrase search against plain loops."""

import random
import re

from runledger.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(ws):
    return {tuple(ws[i:i + 13]) for i in range(max(len(ws) - 12, 1))} if ws else set()


def brute(docs, items):
    phrases = {}
    for item, text in items:
        if item is not None:
            for w in windows(words(text)):
                phrases.setdefault(w, set()).add(str(item))
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for w, ids in phrases.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= ids
        out.append((doc_id, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]))
                   for r in decontam.find_contamination(d, b).collect()), key=str)


def tables(seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Of", "and", "été", "x1", "日本"] + [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 13, 14, 40])))) for i in range(25)]
    docs = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6:
            item = rng.choice(items)[1].split()
            at, a = rng.randint(0, len(body)), rng.randint(0, max(len(item) - 14, 0))
            body[at:at] = item[a:a + rng.choice([12, 13, 30])]
        docs.append((i, rng.choice([" ", ", ", ".\n"]).join(body)))
    return docs, items


def test_against_loops(spark):
    docs, items = tables()
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    item = " ".join(f"t{i}" for i in range(20))
    items = [(1, None), (2, ""), (3, "--"), (4, "solo"), (5, item), (5, item + " more"), (None, "ghost"), (12, "a a a")]
    docs = [(1, None), (1, ""), (None, "SOLO, ghost"), (7, item.upper()), (7, item.upper()),
            (8, "a a a a b " * 3000 + item), (9, item.replace(" ", "\x7f"))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "WINDOWS_PER_BLOCK", 40)
    monkeypatch.setattr(decontam, "VOCABULARY_LIMIT", 0)
    monkeypatch.setattr(decontam, "CANDIDATES_PER_STEP", 5)
    monkeypatch.setattr(decontam, "fits_broadcast", lambda df: False)
    docs, items = tables(4)
    assert run(spark, docs, items) == brute(docs, items)


def test_proximity(spark):
    item = [f"t{i}" for i in range(13)]
    moved = item[:6] + ["gap"] + item[6:]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(item)), (3, " ".join(reversed(item)))],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_contamination(docs, bench).collect()}
    assert (rows[1]["items"], rows[1].near_items, rows[1].n_hit) == ([], ["9"], 0)
    assert (rows[2]["items"], rows[2].near_items, rows[2].n_hit) == (["9"], [], 13)
    assert (rows[3]["items"], rows[3].near_items) == ([], [])


def test_drop(spark):
    item = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item, "a"), (2, "clean " * 30, "b"), (3, item + " pad" * 300, "c"), (4, None, "d"), (None, item, "e")],
                                 "doc_id long, text string, source string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.source for r in kept.collect()} == {"b", "c", "d"}


def test_near_match_that_begins_before_its_text(spark):
    """The words of a short item stand turned round at the very start of a text."""
    docs = spark.createDataFrame([(1, "common common"), (2, "rare common mid common")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(9, "common mid rare")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_contamination(docs, bench).collect()}
    assert rows[1].near_items == [] and rows[2]["items"] == []
    near = spark.createDataFrame([(1, "pad pad"), (2, "rare common")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(9, "common rare")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_contamination(near, bench).collect()}
    assert (rows[1].near_items, rows[2].near_items) == ([], ["9"])


def test_near_match_belongs_to_the_text_of_its_rarest_word(spark):
    docs = spark.createDataFrame([(1, "x a b x"), (2, "c a b"), (3, "a b a b")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_contamination(docs, bench, slack=3).collect()}
    assert [rows[i].near_items for i in (1, 2, 3)] == [[], ["9"], []]


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontam, "WINDOWS_PER_BLOCK", 40)
    docs, items = tables(5)
    made, gone, blocks = [], [], decontam._blocks

    def watched(*args):
        n, found = blocks(*args)

        def each():
            for shared in found:
                assert made == gone
                made.append(id(shared))
                destroy = shared.destroy
                shared.destroy = lambda shared=shared, destroy=destroy: (gone.append(id(shared)), destroy())
                yield shared
        return n, each()
    monkeypatch.setattr(decontam, "_blocks", watched)
    assert run(spark, docs, items) == brute(docs, items)
    assert len(made) > 2 and made == gone


def mirrored(n):
    """Two words of n letters that polynomial hashes modulo 2^64 cannot tell apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_that_sums_cannot_tell_apart(spark):
    pairs = [mirrored(n) for n in (1024, 2048)]
    docs = [(i, w) for i, (_, w) in enumerate(pairs)] + [(9, pairs[0][0])]
    items = [(i, w) for i, (w, _) in enumerate(pairs)]
    found = run(spark, docs, items)
    assert found == brute(docs, items)
    assert [row[2] for row in found] == [0, 0, 1]
