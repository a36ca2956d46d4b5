"""Document fingerprints by winnowing, and their likeness along the order of ids."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runledger.llm import ranges, textops

# Any run of GRAM_BYTES + WINDOW - 1 = 100 equal bytes shares a selected gram.
GRAM_BYTES, WINDOW = 24, 77
ROWS_PER_RANGE = 4000
_PLACES = np.uint64(0xFFFFFFFF)

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, positions array<int>")


def _sliding_min(values, width):
    """Minimum of every run of `width` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def select(data, hasher, k=GRAM_BYTES, window=WINDOW):
    """(hashes, positions) of the grams that winnowing selects from bytes.

    Every window of consecutive grams gives its smallest hash, the rightmost of
    equal ones; a text with fewer grams than a window is one window, and one
    with fewer than k bytes is one gram. Empty text selects nothing.
    """
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    sums = hasher.prefix(data)
    hashes = hasher.grams(sums, min(k, len(data)))
    keys = (hashes & ~_PLACES) | (_PLACES - np.arange(len(hashes), dtype=np.uint64))
    lowest = _sliding_min(keys, min(window, len(keys)))
    lowest = lowest[np.concatenate([[True], lowest[1:] != lowest[:-1]])]
    return (lowest >> np.uint64(32)).astype(np.uint32), (_PLACES - (lowest & _PLACES)).astype(np.int64)


def likeness(a, b):
    """Share of common hashes of two sorted sets: 1 for equal ones, 0 for strangers."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_of(hashes):
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs, k=GRAM_BYTES, window=WINDOW):
    """(doc_id, hashes, positions) of every row: selected grams with their byte positions.

    Null text is empty and selects nothing.
    """
    def run(batches):
        hasher = textops.Hasher()
        for chunk in textops.chunks(batches):
            data, bounds = textops.text_bytes(chunk.column("text"))
            found = [select(data[a:b], hasher, k, window) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                chunk.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, hashes array<long>, positions array<long>")


class _Text:
    """A row with its fingerprint, worked out once for itself and for the row before."""

    def __init__(self, doc_id, text, hasher, k, window):
        self.doc_id, self.text = doc_id, text
        self.hashes, self.positions = select(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), hasher, k, window)
        self.set = np.unique(self.hashes)

    def beside(self, other, hasher, k, window):
        n = len(self.text)
        cut = n // 3
        edited = self.text[:n - cut] + other.text[:cut]
        raw = edited.encode("utf-8", "surrogatepass")
        hashes, _ = select(np.frombuffer(raw, np.uint8), hasher, k, window)
        return (self.doc_id, n, hashlib.sha256(raw).hexdigest(), text_of(self.hashes), text_of(hashes),
                likeness(self.set, np.unique(hashes)), likeness(self.set, other.set), self.positions.tolist())


def _neighbours(k, window):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches):
        hasher = textops.Hasher()
        held = None  # (range, row) that still waits for the one after it
        for chunk in textops.chunks(batches):
            rows = []
            for number, guard, doc_id, text in zip(*(chunk.column(n).to_pylist() for n in ("range", "guard", "doc_id", "text"))):
                if guard and (held is None or held[0] != number):
                    continue  # the range's last row has met its guard
                row = _Text(doc_id, text or "", hasher, k, window)
                if held is not None and held[0] == number:
                    rows.append(held[1].beside(row, hasher, k, window))
                held = None if guard else (number, row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return run


def with_neighbours(docs, k=GRAM_BYTES, window=WINDOW, rows_per_range=ROWS_PER_RANGE):
    """Fingerprints of every row and of its edited text, held against the next row's.

    Rows go by descending doc_id; after the last comes the first. In the edited
    text the last third is the start of the next text. Rows that repeat an id
    follow each other in the order of a hash of their texts; rows without id
    come after all others. A single row is its own next. Null text is empty;
    two empty fingerprints are alike (1), an empty and another are not (0). An
    empty table gives no rows; other columns are ignored.

    Ids are cut into exact ranges; each text moves once, and the highest row of
    a range is also sent to the range above it, which needs it as next row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lows, highs = ranges.cuts(rows, "doc_id", rows_per_range)
    n = max(len(lows), 1)
    keyed = rows.select("*", ranges.key_of("doc_id").alias("key"), F.xxhash64("text").alias("tie"))
    keyed = keyed.withColumn("range", ranges.range_of(F.col("key"), lows or [0]))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guard"))
    extra = F.struct(((F.col("range") + 1) % n).alias("range"), F.lit(True).alias("guard"))
    places = F.when(ranges.is_highest(F.col("key"), highs), F.array(own, extra)).otherwise(F.array(own))
    placed = keyed.select("doc_id", "text", "key", "tie", F.explode(places).alias("place"))
    placed = placed.select(F.col("place.range").alias("range"), F.col("place.guard").alias("guard"), "key", "tie", "doc_id", "text")
    placed = placed.repartitionById(n, "range").sortWithinPartitions("range", "guard", F.desc("key"), "tie")
    return placed.mapInArrow(_neighbours(k, window), SCHEMA)
