"""The classifier: gradients, held-out accuracy, bounds of the sample, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from runledger.llm import quality


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 4, 2])
    first, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(3), sizes)
    x, target = rng.normal(size=(7, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    h, a = quality.HIDDEN, quality.ATTENTION
    w = {"W": rng.normal(size=(quality.FEATURES, h)) * 0.05, "b": rng.normal(size=h), "V": rng.normal(size=(h, a)),
         "v": rng.normal(size=a), "U": rng.normal(size=(h, a)), "u": rng.normal(size=a), "a": rng.normal(size=a),
         "c": rng.normal(size=h), "d": np.zeros(1)}

    def loss():
        p = quality.QualityModel._forward(w, x, first, bag)[-1]
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))
    grads = quality.QualityModel._gradients(w, x, first, bag, target)
    for name, value in w.items():
        place = tuple(rng.integers(0, s) for s in value.shape)
        kept = value[place]
        value[place] = kept + 1e-5
        up = loss()
        value[place] = kept - 1e-5
        down = loss()
        value[place] = kept
        assert abs((up - down) / 2e-5 - grads[name][place]) < 1e-6, name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def table(spark, n=120):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["water", "stone", "river"]) for _ in range(60)), 1) for i in range(n)]
    bad = [(i + n, "!!$$ " * rng.randint(1, 400), 0) for i in range(n)]
    rows = good + bad + [(900, None, None), (901, "", None), (None, "river stone", None), (3, good[3][1], None)]
    docs = spark.createDataFrame([(d, t, "c") for d, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows if q is not None] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    return rows, docs, labels


def test_odd_rows_and_held_out(spark):
    rows, docs, labels = table(spark)
    found = quality.score_documents(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    good = {d: q for d, _, q in rows if q is not None}
    assert all(r.predicted == good[r.doc_id] for r in found if r.doc_id in good)


def test_held_out_labels_change_nothing(spark):
    _, docs, labels = table(spark, 40)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(
        quality.F.col("quality")))
    scores = [sorted((str(r.doc_id), r.score) for r in quality.score_documents(docs, x).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_sample_is_bounded(spark):
    _, docs, labels = table(spark, 60)
    assert len(quality._sample(docs, labels, 10, 10_000)) <= 10
    assert sum(1 for _ in quality._sample(docs, labels, 100, 25)) <= 25


def test_untrained_and_empty(spark):
    _, docs, labels = table(spark, 5)
    none = labels.limit(0)
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {quality.UNTRAINED_SCORE}
    assert quality.keep_good(docs, none).count() == docs.count()
    assert quality.score_documents(docs.limit(0), labels).collect() == []


def test_passages_cover_whole_texts():
    features, first = quality.encode(pa.array(["a" * 1300, None, "b"]))
    assert first.tolist() == [0, 3, 4] and len(features) == 5
    assert abs(features[:3, -3].sum() * quality.PASSAGE_BYTES - 1300) < 1e-2


def test_features_do_not_depend_on_other_rows():
    texts = ["b", "water", "", None, "é" * 256, "x" * 511 + "!", "stone\n", "b"]
    alone = [quality.encode(pa.array([t], pa.string()))[0] for t in texts]
    for order in (range(8), range(7, -1, -1), [1, 0, 3, 6, 4, 2, 7, 5]):
        features, first = quality.encode(pa.array([texts[i] for i in order], pa.string()))
        ends = [*first[1:], len(features)]
        for i, a, b in zip(order, first, ends):
            assert np.array_equal(features[a:b], alone[i]), texts[i]


def test_equal_texts_score_alike_anywhere():
    rng = random.Random(6)
    words = ["water", "stone", "!!", "b", "river 7"]
    bags = [quality.encode(pa.array([" ".join(rng.choices(words, k=rng.randint(1, 9)))]))[0] for _ in range(60)]
    model = quality.QualityModel.train(bags, [float(i % 2) for i in range(60)])
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(40)]
    alone = np.array([model.score_rows(pa.array([t]))[0] for t in texts])
    for _ in range(5):
        order = rng.sample(range(40), 40)
        assert np.allclose(model.score_rows(pa.array([texts[i] for i in order])), alone[order], rtol=0, atol=1e-5)


def plain_score(model, text):
    """Score of one text by loops over its passages, bytes and pairs."""
    data, hidden, energy = (text or "").encode(), [], []
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    for low in range(0, max(len(data), 1), quality.PASSAGE_BYTES):
        passage = data[low:low + quality.PASSAGE_BYTES]
        grams, kinds = [0] * quality.GRAM_BUCKETS, [0] * quality.CLASSES
        for i, byte in enumerate(passage, low):
            pair = byte << 8 | data[i + 1] if i + 1 < len(data) else byte | int(quality.END)
            grams[(pair * 0x9E3779B1 % (1 << 32)) >> 24] += 1
            kinds[int(quality.BYTE_CLASS[byte])] += 1
        n = max(len(passage), 1)
        features = [*((g / n) ** 0.5 for g in grams), *(k / n for k in kinds), len(passage) / quality.PASSAGE_BYTES,
                    sum(g > 0 for g in grams) / n, max(grams) / n]
        x = (np.array(features) - model.mean) / model.scale
        h = np.tanh(x @ w["W"] + w["b"])
        gate = 1 / (1 + np.exp(-(h @ w["U"] + w["u"])))
        hidden.append(h)
        energy.append(float((np.tanh(h @ w["V"] + w["v"]) * gate) @ w["a"]))
    share = np.exp(energy) / np.exp(energy).sum()
    pooled = sum(s * h for s, h in zip(share, hidden))
    return float(1 / (1 + np.exp(-(pooled @ w["c"] + w["d"])[0])))


def test_scores_against_loops():
    rng = np.random.default_rng(5)
    alphabet = list("abc de. XY#é中\n\t1")
    texts = [None, "", "a", "é" * 700, *("".join(rng.choice(alphabet, rng.integers(0, 4000))) for _ in range(20))]
    bags = []
    for text in texts:
        bags.append(quality.encode(pa.array([text], pa.string()))[0])
    model = quality.QualityModel.train(bags, [i % 2 for i in range(len(texts))])
    found = model.score_rows(pa.array(texts, pa.string()))
    assert len(set(np.round(found, 3))) > 3
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=1e-4)
