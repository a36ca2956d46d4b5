"""Benchmark decontamination over a distributed positional inverted index.

The training texts are cut in segments of whole rows. A segment is one row of
the index: the sorted terms and, term by term, the positions of their
occurrences. A phrase is looked up in a segment by taking the postings of its
rarest term as candidates and intersecting them with the offset-adjusted
postings of the other terms, rarest first. Segments are bounded, so a term that
holds a third of all tokens has its postings spread over all of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from runledger.llm import textops
from runledger.session import fits_broadcast, materialise

WINDOW_WORDS = 13
SLACK_WORDS = 2
WINDOWS_PER_BLOCK = 100_000
VOCABULARY_LIMIT = 4_000_000
SEGMENT_BYTES = 2 << 20
CANDIDATES_PER_STEP = 1 << 20

INDEX_SCHEMA = ("segment long, doc_id array<long>, text_key array<long>, first array<long>, n_words array<long>, "
                "terms array<long>, counts array<long>, postings binary")
PART_SCHEMA = ("segment long, part int, doc_id array<long>, text_key array<long>, first array<long>, n_words array<long>, "
               "places array<long>, changes array<long>, docs array<long>, items array<string>, exact array<boolean>")
FOUND_SCHEMA = ("doc_id long, text_key long, n_words long, n_hit long, "
                "items array<string>, near_items array<string>")


def _terms(hasher, column):
    """(hash of every word, words before each row's end)."""
    data, bounds = textops.text_bytes(column)
    data = textops.LOWER[data]
    starts, ends, before = textops.word_spans(data, bounds, textops.ALNUM)
    return hasher.spans(hasher.prefix(data), starts, ends, data), before


def phrase_windows(benchmark, words=WINDOW_WORDS):
    """(item_id, terms): all windows of consecutive words; a shorter item is one window.

    Items without words give none. Rows without item_id are no items; rows that
    repeat an id are parts of one item.
    """
    def run(batches):
        hasher = textops.Hasher()
        for chunk in textops.chunks(batches):
            hashes, before = _terms(hasher, chunk.column("text"))
            hashes = hashes.view(np.int64)
            items, phrases = [], []
            for item, a, b in zip(chunk.column("item_id").to_pylist(), before[:-1], before[1:]):
                for first in range(a, max(b - words, a) + 1 if b > a else a):
                    items.append(item)
                    phrases.append(hashes[first:min(first + words, b)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(phrases, pa.list_(pa.int64()))], ["item_id", "terms"])
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    return rows.mapInArrow(run, "item_id string, terms array<long>")


def build_index(docs, vocabulary=None, gap=WINDOW_WORDS + 2 * SLACK_WORDS + 1):
    """Positional postings of docs(doc_id, text), one row per segment.

    Positions count words; rows of a segment are `gap` apart, so that no phrase
    reaches from one text into the next. With a vocabulary (a broadcast sorted
    array of term hashes) only the postings of its terms are stored; no other
    term can occur in a query.
    """
    def run(batches):
        hasher = textops.Hasher()
        known = vocabulary.value if vocabulary is not None else None
        if known is not None:
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for number, chunk in enumerate(textops.chunks(batches, limit=SEGMENT_BYTES)):
            hashes, before = _terms(hasher, chunk.column("text"))
            n_words = np.diff(before)
            first = before[:-1] + gap * np.arange(1, chunk.num_rows + 1)
            positions = np.arange(len(hashes)) + np.repeat(first - before[:-1], n_words)
            if known is not None:
                keep = np.flatnonzero(seen[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
                place = np.searchsorted(known, hashes[keep])
                keep = keep[known[np.minimum(place, len(known) - 1)] == hashes[keep]] if len(known) else keep[:0]
                hashes, positions = hashes[keep], positions[keep]
            order = np.argsort(hashes, kind="stable")
            hashes, positions = hashes[order], positions[order].astype(np.uint32)
            terms, counts = np.unique(hashes, return_counts=True)
            deltas = np.diff(positions, prepend=np.uint32(0))
            yield pa.RecordBatch.from_arrays([
                pa.array([(TaskContext.get().partitionId() << 32) | number], pa.int64()),
                pa.array([chunk.column("doc_id").to_numpy(zero_copy_only=False)], pa.list_(pa.int64()), from_pandas=True)
                if chunk.column("doc_id").null_count == 0 else
                pa.array([chunk.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([chunk.column("text_key").to_pylist()], pa.list_(pa.int64())),
                pa.array([first], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64())),
                pa.array([terms.view(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                pa.array([textops.pack(deltas)], pa.binary())],
                ["segment", "doc_id", "text_key", "first", "n_words", "terms", "counts", "postings"])
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, INDEX_SCHEMA)


class _Segment:
    def __init__(self, row):
        self.first = np.asarray(row["first"], np.int64)
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.terms = np.asarray(row["terms"], np.int64).view(np.uint64)
        self.counts = np.asarray(row["counts"], np.int64)
        self.low = np.cumsum(self.counts) - self.counts
        deltas = textops.unpack(row["postings"], np.uint32, self.counts.sum())
        self.positions = np.cumsum(deltas, dtype=np.uint32).astype(np.int64)
        # All postings lists as one sorted array of (term number, position).
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.positions
        self.size = int(self.first[-1] + self.n_words[-1]) + 1 if len(self.first) else 1

    def _has(self, keys, slack):
        place = np.minimum(np.searchsorted(self.keys, keys - slack), len(self.keys) - 1)
        return self.keys[place] <= keys + slack if slack else self.keys[place] == keys

    def search(self, block, slack):
        """(window, start, exact) of all phrase and proximity matches."""
        if not len(self.terms):
            return
        place = np.minimum(np.searchsorted(self.terms, block["terms"]), len(self.terms) - 1)
        used = np.arange(block["terms"].shape[1]) < block["length"][:, None]
        whole = np.flatnonzero(((self.terms[place] == block["terms"]) | ~used).all(axis=1))
        candidates = np.cumsum(self.counts[place[whole, 0]])
        first = 0
        while first < len(whole):
            done = candidates[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(candidates, done + CANDIDATES_PER_STEP, "right")))
            yield self._intersect(block, place, whole[first:last], slack)
            first = last

    def _intersect(self, block, place, windows, slack):
        n = self.counts[place[windows, 0]]
        window = np.repeat(windows, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[self.low[place[window, 0]] + inside] - block["offset"][window, 0]
        exact = np.ones(len(window), dtype=bool)
        for rank in range(1, place.shape[1]):
            more = rank < block["length"][window]
            keys = (place[window, rank].astype(np.int64) << 32) | (start + block["offset"][window, rank])
            near = ~more | self._has(keys, slack)
            exact &= ~more | self._has(keys, 0)
            window, start, exact = window[near], start[near], exact[near]
            if not len(window):
                break
        return window, start, exact

    def doc_of(self, start):
        return np.searchsorted(self.first, start, "right") - 1


def _items_by_doc(pairs, n_docs):
    found = [[] for _ in range(n_docs)]
    for doc, item in sorted(pairs):
        found[doc].append(item)
    return found


def _search(segment, block, slack):
    """(marks at which exact matches begin and end, exact pairs, near pairs) of a block; pairs are (row, item_id)."""
    marks, exact_pairs, near_pairs = np.zeros(segment.size + 64, np.int64), set(), set()
    for window, start, exact in segment.search(block, slack):
        length = block["length"][window]
        # A proximity match may begin before its text, but its rarest term stands in it.
        doc = segment.doc_of(start + block["offset"][window, 0])
        np.add.at(marks, start[exact], 1)
        np.add.at(marks, (start + length)[exact], -1)
        for d, w, e in set(zip(doc.tolist(), window.tolist(), exact.tolist())):
            (exact_pairs if e else near_pairs).update((d, item) for item in block["items"][w])
    return marks, exact_pairs, near_pairs


def _found(row, marks, exact_pairs, near_pairs):
    first, n_words = np.asarray(row["first"], np.int64), np.asarray(row["n_words"], np.int64)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    n_hit = covered[first + n_words] - covered[first]
    return pa.RecordBatch.from_arrays([
        pa.array(row["doc_id"], pa.int64()), pa.array(row["text_key"], pa.int64()),
        pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
        pa.array(_items_by_doc(exact_pairs, len(first)), pa.list_(pa.string())),
        pa.array(_items_by_doc(near_pairs - exact_pairs, len(first)), pa.list_(pa.string()))],
        ["doc_id", "text_key", "n_words", "n_hit", "items", "near_items"])


def _each(work):
    """Runs work(row) for one row after the other; None gives no rows."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = work({name: batch.column(name)[i].as_py() for name in batch.schema.names})
                if out is not None:
                    yield out
            textops.release()
    return run


def _searcher(shared, slack):
    """The answer, when there is one block or none."""
    def rows_of(row):
        segment = _Segment(row)
        block = shared.value if shared is not None else None
        return _found(row, *(_search(segment, block, slack) if block else (np.zeros(segment.size + 64, np.int64), set(), set())))
    return _each(rows_of)


def _part_searcher(shared, slack, part):
    """What one of several blocks finds, for each segment in which it finds something."""
    def rows_of(row):
        marks, exact, near = _search(_Segment(row), shared.value, slack)
        if not exact and not near:
            return None
        places, pairs = np.flatnonzero(marks), [*((*p, True) for p in exact), *((*p, False) for p in near)]
        docs, items, kinds = zip(*pairs)
        values = [row["segment"], part, None, None, None, None, places, marks[places], docs, items, kinds]
        kinds = [pa.int64(), pa.int32()] + [pa.list_(pa.int64())] * 7 + [pa.list_(pa.string()), pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                          [c.split()[0] for c in PART_SCHEMA.split(", ")])
    return _each(rows_of)


def _merge(batches):
    """Answers of segments from what all blocks found; the rows of a segment follow each other, part 0 first."""
    row = None
    for part in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
        if part["part"] == 0:
            if row is not None:
                yield _found(row, marks, exact, near)
            row, exact, near = part, set(), set()
            size = row["first"][-1] + row["n_words"][-1] + 1 if row["first"] else 1
            marks = np.zeros(size + 64, np.int64)
        else:
            marks[part["places"]] += part["changes"]
            for doc, item, is_exact in zip(part["docs"], part["items"], part["exact"]):
                (exact if is_exact else near).add((doc, item))
    if row is not None:
        yield _found(row, marks, exact, near)


def _blocks(windows, index, words):
    """Number of blocks of the distinct windows and an iterator that broadcasts one; terms by their count in the index."""
    spark = windows.sparkSession
    distinct = materialise(windows.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(
        F.monotonically_increasing_id().alias("window"), "terms", "items"), "windows")
    n = distinct.count()
    places = distinct.select("window", F.posexplode("terms").alias("offset", "term"))
    counted = materialise(index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(
        F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n")).join(
            places.select("term").distinct(), "term", "left_semi"), "term-counts")
    # A word may stand in most windows: where its size allows, the small side goes to them.
    placed = places.join(F.broadcast(counted) if fits_broadcast(counted) else counted, "term", "left")
    ranked = materialise(placed.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("ranked")).join(
            distinct.select("window", "items"), "window"), "ranked-windows")
    n_blocks = -(-n // WINDOWS_PER_BLOCK)

    def block(number):
        rows = ranked.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == number).select("ranked", "items").toArrow()
        terms = np.zeros((len(rows), words), np.uint64)
        offsets = np.zeros((len(rows), words), np.int64)
        length = np.zeros(len(rows), np.int64)
        for i, ranked_terms in enumerate(rows.column("ranked").to_pylist()):
            length[i] = len(ranked_terms)
            for rank, t in enumerate(ranked_terms):
                terms[i, rank], offsets[i, rank] = t["term"] % (1 << 64), t["offset"]
        return spark.sparkContext.broadcast({
            "terms": terms, "offset": offsets, "length": length, "items": rows.column("items").to_pylist()})
    return n_blocks, map(block, range(n_blocks))


def _vocabulary(windows):
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    if terms.count() > VOCABULARY_LIMIT:
        return None
    found = np.sort(np.asarray(terms.toArrow().column(0), dtype=np.int64).view(np.uint64))
    return windows.sparkSession.sparkContext.broadcast(found)


def find_contamination(docs, benchmark, words=WINDOW_WORDS, slack=SLACK_WORDS):
    """Per row of docs: doc_id, text_key, n_words, n_hit, items, near_items.

    n_hit counts the words inside any exact occurrence of any window; items are
    the item_ids with an exact window, sorted. near_items have no exact window
    in the text but one whose words all stand within `slack` words of their
    place beside its rarest word. text_key is xxhash64 of the text.

    Null and wordless texts have 0 words and no items. Repeated rows and ids
    are judged row by row. An empty benchmark gives no items. The benchmark goes
    to the tasks in broadcast blocks of at most WINDOWS_PER_BLOCK windows, one
    after the other: a block is dropped before the next one is made, and what the
    blocks find is added up by segment. So every row is held against every
    window, whatever the size of either table.
    """
    windows = materialise(phrase_windows(benchmark, words), "phrases")
    index = materialise(build_index(docs, _vocabulary(windows), words + 2 * slack + 1), "positional-index")
    n_blocks, blocks = _blocks(windows, index, words)
    if n_blocks <= 1:
        return index.mapInArrow(_searcher(next(blocks, None), slack), FOUND_SCHEMA)
    parts = index.select("segment", F.lit(0).alias("part"), "doc_id", "text_key", "first", "n_words")
    for number, shared in enumerate(blocks, 1):
        part = materialise(index.mapInArrow(_part_searcher(shared, slack, number), PART_SCHEMA), f"part-{number}")
        shared.destroy()
        parts = parts.unionByName(part, allowMissingColumns=True)
    return parts.repartition("segment").sortWithinPartitions("segment", "part").mapInArrow(_merge, FOUND_SCHEMA)


def is_contaminated(n_hit, n_words):
    """At least one word in twenty is copied."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs, benchmark):
    """The documents without those of which a twentieth or more stands in the benchmark.

    The verdict follows from the text alone, so repeated rows share it; rows
    without words are clean. All columns are kept. Texts are only shuffled if the list of
    contaminated ones is measured to be beyond the broadcast limit.
    """
    found = find_contamination(docs, benchmark)
    bad = materialise(found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(
        "doc_id", F.col("text_key").alias("key")).distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["key"])
    return docs.join(F.broadcast(bad) if fits_broadcast(bad) else bad, same, "left_anti")
