"""N-gram scores of documents by a weighted backoff automaton whose arcs stay distributed.

States are the histories seen in training, a word has an arc from every history
it followed, and a failure arc leads to the history without its oldest word. A
history h with count c(h) gives its arcs (c(hw) + K p(w)) / (c(h) + K), where p
is the next shorter history's probability, and its failure arc K / (c(h) + K).
A text is scored in one traversal from left to right that carries the state: a
word takes its arc, or the failure arcs up to the state that has one, and the
logarithms of all arcs taken add up.

The automaton grows with the corpus and is never whole in one place. Texts are
cut in bounded segments, and a segment is traversed over the states and arcs
that its own words can reach. A segment sends every distinct n-gram once, with its
count in the training texts, to the bucket of the n-gram's hash; the bucket adds
the counts of all segments and answers each of them in its own order. So a word
that makes up a third of all tokens is one row per segment.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from runledger.llm import textops
from runledger.session import materialise, shuffle_partitions

ORDER = 2
STRENGTH = 2.0
SEGMENT_TOKENS = 1_250_000
GRAMS_PER_BUCKET = 500_000
WALK_TOKENS = 2048

# Stand for the beginning and the end of a text; no word hash can be told apart
# from them other than by chance, like any two words.
BEGIN, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

SEGMENT_SCHEMA = "segment long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_words long, words binary, tokens binary"
GRAM_SCHEMA = "place int, n_order int, bucket int, segment long, n long, hashes binary, counts binary"
ANSWER_SCHEMA = "segment long, n_order int, bucket int, n long, counts binary, train_tokens long, train_words long"
SCORE_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def is_held_out(doc_id):
    """Whether a document is kept from training; rows without id are trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


class _Segment:
    """Documents of one segment as an array of word numbers, with the hash of every word."""

    def __init__(self, doc_id, held_out, n_tokens, words, tokens):
        self.doc_id, self.held_out = doc_id, held_out
        self.n_tokens = np.asarray(n_tokens, np.int64)  # with the end, without the beginning
        self.words, self.tokens = words, tokens
        size = self.n_tokens + 1
        self.first = np.cumsum(size) - size
        self.inside = np.arange(len(tokens)) - np.repeat(self.first, size)
        self.training = np.repeat(~np.asarray(held_out, dtype=bool), size)

    @classmethod
    def build(cls, parts):
        doc_id = [d for p in parts for d in p[0]]
        held_out = [h for p in parts for h in p[1]]
        n_tokens = np.concatenate([p[2] for p in parts])
        words, tokens = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        return cls(doc_id, held_out, n_tokens, words, tokens.astype(np.uint32))

    @classmethod
    def load(cls, row):
        n_tokens = np.asarray(row["n_tokens"], np.int64)
        words = np.cumsum(textops.unpack(row["words"], np.uint64, row["n_words"]), dtype=np.uint64)
        tokens = textops.unpack(row["tokens"], np.uint32, int((n_tokens + 1).sum()))
        return cls(row["doc_id"], row["held_out"], n_tokens, words, tokens)

    def grams(self, order):
        """(distinct sorted hashes, number of the n-gram that ends at each place, places) of an order."""
        if order == 1:
            return self.words, self.tokens, np.ones(len(self.tokens), dtype=bool)
        hashes = self.words[self.tokens]
        longer = hashes
        for n in range(1, order):
            longer = np.concatenate([longer[:1], textops.mix(longer[:-1] * _STEP + hashes[1:])])
        whole = self.inside >= order - 1
        distinct, number = np.unique(longer[whole], return_inverse=True)
        numbers = np.zeros(len(hashes), np.int64)
        numbers[whole] = number
        return distinct, numbers, whole


def _segments(docs):
    def rows_of(parts, number):
        s = _Segment.build(parts)
        return pa.RecordBatch.from_arrays([
            pa.array([(TaskContext.get().partitionId() << 32) | number], pa.int64()),
            pa.array([s.doc_id], pa.list_(pa.int64())), pa.array([s.held_out], pa.list_(pa.bool_())),
            pa.array([s.n_tokens], pa.list_(pa.int64())), pa.array([len(s.words)], pa.int64()),
            pa.array([textops.pack(np.diff(s.words, prepend=np.uint64(0)))], pa.binary()),
            pa.array([textops.pack(s.tokens)], pa.binary())],
            ["segment", "doc_id", "held_out", "n_tokens", "n_words", "words", "tokens"])

    def run(batches):
        hasher, parts, size, number = textops.Hasher(), [], 0, 0
        for chunk in textops.chunks(batches):
            data, bounds = textops.text_bytes(chunk.column("text"))
            data = textops.LOWER[data]
            starts, ends, before = textops.word_spans(data, bounds, textops.NONBLANK)
            hashes = hasher.spans(hasher.prefix(data), starts, ends, data)
            n = np.diff(before)
            at = before[:-1] + 2 * np.arange(len(n))
            stream = np.empty(len(hashes) + 2 * len(n), np.uint64)
            stream[at], stream[at + n + 1] = BEGIN, END
            inner = np.arange(len(hashes)) + np.repeat(2 * np.arange(len(n)) + 1, n)
            stream[inner] = hashes
            parts.append((chunk.column("doc_id").to_pylist(), chunk.column("held_out").to_pylist(), n + 1, stream))
            size += len(stream)
            if size >= SEGMENT_TOKENS:
                yield rows_of(parts, number)
                parts, size, number = [], 0, number + 1
        if parts:
            yield rows_of(parts, number)
        textops.release()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, SEGMENT_SCHEMA)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        del batch
        textops.release()


def _bounds(distinct, buckets):
    """Places at which each bucket's share of sorted hashes begins; buckets are ranges of hashes."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])


def _gram_rows(order, buckets):
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [part.split()[0] for part in GRAM_SCHEMA.split(", ")]

    def run(batches):
        for row in _rows(batches):
            segment = _Segment.load(row)
            for n in range(1, order + 1):
                distinct, numbers, whole = segment.grams(n)
                counts = np.bincount(numbers[whole & segment.training], minlength=len(distinct)).astype(np.uint32)
                cuts = _bounds(distinct, buckets)
                out = [((n - 1) * buckets + b, n, b, row["segment"], high - low,
                        textops.pack(np.diff(distinct[low:high], prepend=np.uint64(0))), textops.pack(counts[low:high]))
                       for b, (low, high) in enumerate(zip(cuts, cuts[1:])) if high > low]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return run


def _count(batches):
    """Answers of one bucket after the other: the summed counts, in each segment's own order."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in ANSWER_SCHEMA.split(", ")]

    def answers(rows):
        hashes = [np.cumsum(textops.unpack(r["hashes"], np.uint64, r["n"]), dtype=np.uint64) for r in rows]
        counts = np.concatenate([textops.unpack(r["counts"], np.uint32, r["n"]) for r in rows])
        distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)
        tokens, words = 0, 0
        if rows[0]["n_order"] == 1:
            real = total[distinct != BEGIN]
            tokens, words = int(real.sum()), int((real > 0).sum())
        at = np.cumsum([0, *(r["n"] for r in rows)])
        for i, (r, low, high) in enumerate(zip(rows, at, at[1:])):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((
                r["segment"], r["n_order"], r["bucket"], r["n"], textops.pack(total[number[low:high]]),
                tokens if i == 0 else 0, words if i == 0 else 0), types)], names)

    held = []
    for row in _rows(batches):
        if held and (held[0]["n_order"], held[0]["bucket"]) != (row["n_order"], row["bucket"]):
            yield from answers(held)
            held = []
        held.append(row)
    if held:
        yield from answers(held)


class Automaton:
    """States and arcs that the words of one segment can reach.

    State 0 has no history; the other states are the seen histories of up to
    order - 1 words. `failure` and `log_failure` give each state's failure arc.
    Word arcs are sorted by `key`, state times words plus word; `log_arc` is the
    log10 probability and `target` the state behind the arc. State 0 has an arc
    for every word, seen or not, so every word is read.
    """

    def __init__(self, segment, answers, order, strength, train_tokens, train_words):
        self.order, self.words = order, len(segment.words)
        failure, log_failure = [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, logs, targets = [], [], []
        before, shorter, seen_before, offset, longer_offset = None, None, None, 0, 1
        for n in range(1, order + 1):
            _, numbers, whole = segment.grams(n)
            seen = answers[n].astype(np.float64)
            if n == 1:
                history, suffix = np.zeros(len(seen), np.int64), None
                word = np.arange(len(seen))
                probability = (seen + 1) / (train_tokens + train_words + 1)
                known = np.ones(len(seen), dtype=bool)
                state = history
            else:
                at = np.flatnonzero(whole)
                history, suffix, word = (np.zeros(len(seen), np.int64) for _ in range(3))
                history[numbers[at]] = before[at - 1]
                suffix[numbers[at]] = before[at]
                word[numbers[at]] = segment.tokens[at]
                probability = (seen + strength * shorter[suffix]) / (seen_before[history] + strength)
                known = seen > 0
                state = offset + history
            if n < order:
                # A seen history of n words is a state; a failure arc drops its oldest word.
                failure.append(np.zeros(len(seen), np.int64) if n == 1 else offset + suffix)
                log_failure.append(np.log10(strength / (seen + strength)))
                target = np.where(seen > 0, longer_offset + np.arange(len(seen)), 0)
            else:
                target = np.zeros(len(seen), np.int64) if n == 1 else offset + suffix
            keys.append((state * self.words + word)[known])
            logs.append(np.log10(probability[known]))
            targets.append(target[known])
            before, shorter, seen_before = numbers, probability, seen
            offset, longer_offset = longer_offset, longer_offset + len(seen)
        self.failure, self.log_failure = np.concatenate(failure), np.concatenate(log_failure)
        key = np.concatenate(keys)
        by_key = np.argsort(key, kind="stable")
        self.key, self.log_arc, self.target = key[by_key], np.concatenate(logs)[by_key], np.concatenate(targets)[by_key]

    def read(self, state, word):
        """(states, log10 probabilities) after each of the states has read a word."""
        state, total = state.copy(), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            key = state[left] * self.words + word[left]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[arc] == key
            done, arc = left[there], arc[there]
            total[done] += self.log_arc[arc]
            state[done] = self.target[arc]
            left = left[~there]
            total[left] += self.log_failure[state[left]]
            state[left] = self.failure[state[left]]
        return state, total

    def walk(self, segment):
        """Log10 probability of each text of the segment, from one traversal of all of them side by side.

        Long texts are walked in pieces of WALK_TOKENS. As a state remembers
        order - 1 words, a piece that starts so much earlier without a history is in
        the right state at its first word.
        """
        size = segment.n_tokens + 1
        pieces = -(-size // WALK_TOKENS)
        text = np.repeat(np.arange(len(size)), pieces)
        inner = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WALK_TOKENS
        warm = np.minimum(inner, self.order - 1)
        length = np.minimum(size[text] - inner, WALK_TOKENS) + warm
        longest = np.argsort(-length, kind="stable")
        text, warm, length = text[longest], warm[longest], length[longest]
        place = segment.first[text] + inner[longest] - warm
        # The first place of a text is its beginning, a state and no token.
        silent = np.maximum(warm, (inner[longest] == 0).astype(np.int64))
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for step, n in enumerate(active):
            state[:n], taken = self.read(state[:n], segment.tokens[place[:n] + step].astype(np.int64))
            total[:n] += np.where(step >= silent[:n], taken, 0.0)
        return np.bincount(text, weights=total, minlength=len(size))


def _scorer(order, strength, train_tokens, train_words):
    def score(segment, answers):
        base = np.log10(train_tokens + train_words + 1)
        index = np.flatnonzero(segment.inside > 0)  # the beginning is a state and no token
        starts = np.searchsorted(index, np.flatnonzero(segment.inside == 1))
        count = answers[1][segment.tokens[index]]
        known = np.add.reduceat((count > 0).astype(np.int64), starts)
        plain = np.add.reduceat(np.log10(count + 1.0) - base, starts)
        total = Automaton(segment, answers, order, strength, train_tokens, train_words).walk(segment)
        return pa.RecordBatch.from_arrays([
            pa.array(segment.doc_id, pa.int64()), pa.array(segment.held_out, pa.bool_()), pa.array(segment.n_tokens),
            pa.array(known), pa.array(plain), pa.array(total)],
            [part.split()[0] for part in SCORE_SCHEMA.split(", ")])

    def run(batches):
        answers = {}
        for row in _rows(batches):
            if row["n_order"] <= order:
                answers.setdefault(row["n_order"], []).append(textops.unpack(row["counts"], np.int64, row["n"]))
            else:
                yield score(_Segment.load(row), {n: np.concatenate(parts) for n, parts in answers.items()})
                answers = {}
    return run


def score(docs, order=ORDER, strength=STRENGTH):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows of docs(doc_id, text) that are not held out. Tokens are
    the words of the lower-cased text and one end; null and blank texts are the
    end alone. base_score sums log10((c + 1) / (N + V + 1)) over the tokens,
    score the automaton's log10 probabilities. Repeated rows count and are
    scored each for itself; rows without doc_id are trained on. When nothing is
    left to train on, all counts are 0. An empty table gives no rows.
    """
    segments = materialise(_segments(docs), "lm-segments")
    total = segments.agg(F.sum("n_words").alias("words"), F.sum(F.aggregate(
        "n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("tokens"), F.count(F.lit(1)).alias("segments")).first()
    size = (total["words"] or 0) + (order - 1) * (total["tokens"] or 0)
    parts = max(shuffle_partitions(docs.sparkSession), total["segments"])
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // (order * GRAMS_PER_BUCKET)))
    grams = segments.mapInArrow(_gram_rows(order, buckets), GRAM_SCHEMA)
    grams = grams.repartition(buckets, "place").sortWithinPartitions("n_order", "bucket", "segment")
    answers = materialise(grams.mapInArrow(_count, ANSWER_SCHEMA), "lm-answers")
    trained = answers.agg(F.sum("train_tokens").alias("n"), F.sum("train_words").alias("v")).first()
    n, v = trained["n"] or 0, trained["v"] or 0
    empty = {f.name: F.lit(None).cast(f.dataType) for f in segments.schema.fields}
    asked = answers.select("segment", "n_order", "bucket", "n", "counts",
                           *[empty[c].alias(c) for c in segments.columns if c != "segment"])
    own = segments.select("segment", F.lit(order + 1).alias("n_order"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("n"),
                          F.lit(None).cast("binary").alias("counts"), *[c for c in segments.columns if c != "segment"])
    together = asked.unionByName(own).repartition(parts, "segment").sortWithinPartitions("segment", "n_order", "bucket")
    scored = together.mapInArrow(_scorer(order, strength, n, v), SCORE_SCHEMA)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
