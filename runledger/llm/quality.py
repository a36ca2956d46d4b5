"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention
learned from the document labels weighs the passages, and the weighted mean of
the encodings is scored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runledger.llm import textops

PASSAGE_BYTES = 512
# Stands for the byte after the last one of a text, which has no neighbour there.
END = 0x10000
GRAM_BUCKETS = 256
CLASSES = 12
FEATURES = GRAM_BUCKETS + CLASSES + 3
HIDDEN, ATTENTION = 24, 12
# Bounds of the sample that a model is fitted on, in documents and in passages.
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 32_000
EPOCHS, BATCH_DOCS, RATE, DECAY = 24, 64, 3e-3, 1e-4
THRESHOLD = 0.7
# Without a single labelled row nothing speaks against any document.
UNTRAINED_SCORE = 1.0


def _byte_classes():
    table = np.full(256, 11, np.int64)
    table[0x80:] = 0
    table[0x61:0x7B] = 1
    table[0x41:0x5B] = 2
    table[0x30:0x3A] = 3
    table[[0x20, 0x09, 0x0D]] = 4
    table[0x0A] = 5
    for number, symbols in enumerate((b".,;:?", b"!", b"#$%&*@^~", b"|<>=+/\\_", b"\"'()-[]{}"), 6):
        table[list(symbols)] = number
    return table


BYTE_CLASS = _byte_classes()


def encode(column):
    """(features of all passages, first passage of every row) of a string column.

    A row is cut every PASSAGE_BYTES bytes; an empty or null one is a single
    empty passage. Features are shares: hashed byte pairs, byte classes, length,
    distinct pairs and the share of the commonest pair. No feature depends on
    other rows: the last byte of a row is paired with END.
    """
    data, bounds = textops.text_bytes(column)
    size = np.diff(bounds)
    n = np.maximum(-(-size // PASSAGE_BYTES), 1)
    first = np.cumsum(n) - n
    total = int(n.sum())
    inside = np.arange(len(data)) - np.repeat(bounds[:-1], size)
    passage = np.repeat(first, size) + inside // PASSAGE_BYTES
    length = np.bincount(passage, minlength=total)
    pair = data.astype(np.uint32)
    pair[:-1] = (pair[:-1] << 8) | data[1:]
    last = bounds[1:][size > 0] - 1
    pair[last] = data[last] | np.uint32(END)
    bucket = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64)
    grams = np.bincount(passage * GRAM_BUCKETS + bucket, minlength=total * GRAM_BUCKETS).reshape(total, -1)
    kinds = np.bincount(passage * CLASSES + BYTE_CLASS[data], minlength=total * CLASSES).reshape(total, -1)
    share = 1.0 / np.maximum(length, 1)[:, None]
    features = np.empty((total, FEATURES), np.float32)
    features[:, :GRAM_BUCKETS] = np.sqrt(grams * share)
    features[:, GRAM_BUCKETS:GRAM_BUCKETS + CLASSES] = kinds * share
    features[:, -3] = length / PASSAGE_BYTES
    features[:, -2] = (grams > 0).sum(axis=1) * share[:, 0]
    features[:, -1] = grams.max(axis=1, initial=0) * share[:, 0]
    return features, first


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class QualityModel:
    """Parameters of one fitted model; small, and the same size for every corpus."""

    def __init__(self, weights, mean, scale):
        self.weights, self.mean, self.scale = weights, mean, scale

    @staticmethod
    def _forward(w, x, first, bag):
        hidden = np.tanh(x @ w["W"] + w["b"])
        tanh, gate = np.tanh(hidden @ w["V"] + w["v"]), _sigmoid(hidden @ w["U"] + w["u"])
        energy = (tanh * gate) @ w["a"]
        energy = np.exp(energy - np.maximum.reduceat(energy, first)[bag])
        attention = energy / np.add.reduceat(energy, first)[bag]
        pooled = np.add.reduceat(attention[:, None] * hidden, first)
        return hidden, tanh, gate, attention, pooled, _sigmoid(pooled @ w["c"] + w["d"])

    @classmethod
    def _gradients(cls, w, x, first, bag, target):
        hidden, tanh, gate, attention, pooled, score = cls._forward(w, x, first, bag)
        out = (score - target) / len(target)
        into = out[:, None] * w["c"]
        d_hidden = attention[:, None] * into[bag]
        d_attention = (hidden * into[bag]).sum(axis=1)
        centre = np.add.reduceat(attention * d_attention, first)
        d_energy = attention * (d_attention - centre[bag])
        d_both = d_energy[:, None] * w["a"]
        d_tanh, d_gate = d_both * gate * (1 - tanh ** 2), d_both * tanh * gate * (1 - gate)
        d_hidden += d_tanh @ w["V"].T + d_gate @ w["U"].T
        d_hidden *= 1 - hidden ** 2
        return {"W": x.T @ d_hidden, "b": d_hidden.sum(axis=0), "V": hidden.T @ d_tanh, "v": d_tanh.sum(axis=0),
                "U": hidden.T @ d_gate, "u": d_gate.sum(axis=0), "a": (tanh * gate).T @ d_energy,
                "c": pooled.T @ out, "d": out.sum(keepdims=True)}

    @classmethod
    def train(cls, bags, targets, seed=7):
        """Fit on feature matrices, one per document, and labels from 0 to 1."""
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        bags = [((b - mean) / scale).astype(np.float64) for b in bags]
        w = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
             "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)), "v": np.zeros(ATTENTION),
             "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)), "u": np.zeros(ATTENTION),
             "a": rng.normal(0, ATTENTION ** -0.5, ATTENTION), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN),
             "d": np.zeros(1)}
        moment = {k: np.zeros_like(v) for k, v in w.items()}
        square = {k: np.zeros_like(v) for k, v in w.items()}
        step, targets = 0, np.asarray(targets, np.float64)
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for low in range(0, len(order), BATCH_DOCS):
                chosen = order[low:low + BATCH_DOCS]
                sizes = np.array([len(bags[i]) for i in chosen])
                x, first = np.concatenate([bags[i] for i in chosen]), np.cumsum(sizes) - sizes
                grads = cls._gradients(w, x, first, np.repeat(np.arange(len(chosen)), sizes), targets[chosen])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * w[k]
                    moment[k] += 0.1 * (g - moment[k])
                    square[k] += 0.001 * (g * g - square[k])
                    w[k] -= RATE * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
        return cls({k: v.astype(np.float32) for k, v in w.items()}, mean, scale)

    def score_rows(self, column):
        """Scores of a string column, one chunk at a time."""
        features, first = encode(column)
        if not len(first):
            return np.zeros(0)
        sizes = np.diff(np.append(first, len(features)))
        x = (features - self.mean) / self.scale
        return self._forward(self.weights, x, first, np.repeat(np.arange(len(first)), sizes))[-1].astype(np.float64)

    def score(self, text):
        """Column of scores for a column of texts; null is scored as empty text."""
        def run(batches):
            for column in batches:
                table = pa.RecordBatch.from_arrays([column], ["text"])
                scores = [self.score_rows(c.column(0)) for c in textops.chunks([table])]
                yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
        return _arrow_udf(run)(text)


def _arrow_udf(run):
    from collections.abc import Iterator

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)
    return F.arrow_udf(scores, "double")


def _sample(docs, labels, max_docs, max_passages):
    """(doc_id, target) of a bounded sample of labelled documents, by a hash of the id.

    Rows that repeat a doc_id in labels count with the mean of their labels.
    """
    target = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg("quality").alias("target"))
    passages = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE_BYTES)
    sized = docs.select("doc_id", F.greatest(passages, F.lit(1)).alias("n")).join(target, "doc_id").groupBy("doc_id").agg(
        F.max("n").alias("n"), F.first("target").alias("target"))
    rows = sized.orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(max_docs).collect()
    chosen, total = {}, 0
    for r in rows:
        if total + r["n"] <= max_passages:
            chosen[r["doc_id"]] = float(r["target"])
            total += r["n"]
    return chosen


def fit(docs, labels, max_docs=TRAIN_DOCS, max_passages=TRAIN_PASSAGES):
    """A model fitted on at most max_docs labelled documents with at most max_passages passages.

    The sample is taken in the order of a hash of doc_id; a document that would
    pass the bound on passages is left out of the sample. Of texts under one doc_id the
    one with the smallest hash is taken. Returns None when no document is labelled.
    """
    chosen = _sample(docs, labels, max_docs, max_passages)
    if not chosen:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in chosen], "doc_id long")

    def run(batches):
        for chunk in textops.chunks(batches):
            features, first = encode(chunk.column("text"))
            ends = np.append(first[1:], len(features))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array([features[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
                ["doc_id", "features"])
    # At most max_docs ids: a bounded broadcast.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))).alias("text"))
    rows = texts.mapInArrow(
        run, "doc_id long, features binary").orderBy("doc_id").collect()
    bags = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in rows]
    return QualityModel.train(bags, [chosen[r["doc_id"]] for r in rows])


def score(docs, labels, text="text", **bounds):
    """Column of quality scores from 0 to 1 for docs[text], with a model fitted on the labels."""
    model = fit(docs, labels, **bounds)
    return F.lit(UNTRAINED_SCORE) if model is None else model.score(F.col(text))


def held_out(doc_id):
    """Whether the labels of a document are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs, labels, **bounds):
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Labels of held-out documents are never read. Null and empty texts have one
    empty passage and a score like any other. Repeated rows are scored alike;
    rows without doc_id are scored and not held out. Without labelled rows every
    score is UNTRAINED_SCORE. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    value = score(docs, labels.filter(~held_out(F.col("doc_id"))), **bounds)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs, labels, **bounds):
    """The documents scored at least THRESHOLD, with all their columns.

    Null and empty texts are scored like any other, repeated rows alike; without
    labelled rows every document is judged by UNTRAINED_SCORE.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    value = score(plain, labels.filter(~held_out(F.col("doc_id"))), **bounds)
    return docs.filter(value >= THRESHOLD)
