"""SimHash near-duplicates by deletion-variant signatures of two long segments."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from runledger.llm import components, textops
from runledger.session import fits_broadcast, materialise

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
_HASHES_PER_STEP = 1 << 15


def simhash(text, words_per_shingle=SHINGLE_WORDS):
    """Fingerprint of UTF-8 bytes: the majority of every bit over the hashes of all shingles."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    width = min(words_per_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for first in range(0, n, _HASHES_PER_STEP):
        bits = np.unpackbits(hashes[first:first + _HASHES_PER_STEP].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs, shingle_words=SHINGLE_WORDS):
    """(doc_id, fingerprint long) of every row; null and blank texts have fingerprint 0."""
    def run(batches):
        for chunk in textops.chunks(batches):
            data, bounds = textops.text_bytes(chunk.column("text"))
            whole = data.tobytes()
            values = [simhash(whole[a:b], shingle_words) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, fingerprint long")


def _segments(max_bits):
    """(shift, width) of so few segments that one of them differs by one bit at most."""
    count = max_bits // 2 + 1
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def signatures(distinct, max_bits=MAX_BITS):
    """One row per fingerprint, segment and wildcard: the segment with that bit deleted.

    Wildcard number `width` deletes nothing: it finds equal segments.
    """
    segments = _segments(max_bits)
    places = F.array(*[F.struct(F.lit(shift).alias("shift"), F.lit(width).alias("width"),
                                F.lit(number * 128).alias("base"))
                       for number, (shift, width) in enumerate(segments)])
    rows = distinct.select("fingerprint", F.explode(places).alias("s")).select(
        "fingerprint", "s.*", F.explode(F.sequence(F.lit(0), F.col("s.width"))).alias("bit"))
    one = F.lit(1).cast("long")
    mask = F.expr("shiftleft(1L, width) - 1L") if len(segments) > 1 else F.lit(-1).cast("long")
    part = F.expr("shiftrightunsigned(fingerprint, shift)").bitwiseAND(mask)
    gone = F.when(F.col("bit") < F.col("width"), F.expr("shiftleft(1L, bit)")).otherwise(one - one)
    return rows.select((F.col("base") + F.col("bit")).alias("sig"),
                       part.bitwiseAND(F.bitwise_not(gone)).alias("value"), "fingerprint")


def _tree(values, near):
    """Edges of spanning trees of the values under near(value, others), breadth first."""
    rest, edges = values, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            hit = near(node, rest)
            found, rest = rest[hit], rest[~hit]
            edges.extend((node, other) for other in found)
            queue.extend(found)
    return edges


def _linker(max_bits):
    segments = _segments(max_bits)

    def shared_bit(sig):
        """Where a wildcard signature deletes a bit of the fingerprint, else -1."""
        shift, width = segments[sig // 128]
        return shift + sig % 128 if sig % 128 < width else -1

    bit_of = np.array([shared_bit(s) if s % 128 <= segments[s // 128][1] else -1
                       for s in range(128 * len(segments))])

    def verified(sig, a, b):
        """Near enough, and found by the one signature kind that answers for the pair."""
        bit, differ = bit_of[sig], a ^ b
        deleted = (differ >> np.maximum(bit, 0).astype(np.uint64)) & np.uint64(1)
        return (np.bitwise_count(differ) <= max_bits) & ((bit < 0) | (deleted == 1))

    def process(sig, fingerprint, firsts, lengths, out):
        pairs = firsts[lengths == 2]
        good = verified(sig[pairs], fingerprint[pairs], fingerprint[pairs + 1])
        out.append((fingerprint[pairs[good]], fingerprint[pairs[good] + 1]))
        for first, length in zip(firsts[lengths > 2], lengths[lengths > 2]):
            values = fingerprint[first:first + length]
            edges = _tree(values, lambda x, others: np.bitwise_count(x ^ others) <= max_bits)
            if edges:
                a, b = zip(*edges)
                out.append((np.array(a, np.uint64), np.array(b, np.uint64)))

    def run(batches):
        held = None
        for batch in _with_end(batches):
            if batch is None:
                if held is None:
                    return
                sig, value, prints, final = *held, True
            else:
                new = [np.asarray(batch.column(i)) for i in range(3)]
                new[2] = new[2].view(np.uint64)
                sig, value, prints = new if held is None else [
                    np.concatenate(x) for x in zip(held, new)]
                final = False
            if not len(sig):
                continue
            change = np.flatnonzero((sig[1:] != sig[:-1]) | (value[1:] != value[:-1])) + 1
            firsts = np.concatenate([[0], change])
            lengths = np.diff(np.concatenate([firsts, [len(sig)]]))
            if not final:  # the last run may go on in the next batch
                held = sig[firsts[-1]:], value[firsts[-1]:], prints[firsts[-1]:]
                firsts, lengths = firsts[:-1], lengths[:-1]
            out = []
            process(sig, prints, firsts, lengths, out)
            a = np.concatenate([x for x, _ in out]).view(np.int64)
            b = np.concatenate([x for _, x in out]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fa", "fb"])
    return run


def _with_end(batches):
    yield from batches
    yield None


def links(distinct, max_bits=MAX_BITS):
    """Links (fa, fb) of distinct fingerprints that keep all components of the full link graph.

    Candidates are the rows of one signature value, which the sort brings
    together; every link is verified on the whole fingerprint. Of a signature
    value with many fingerprints only a spanning forest is given out, found
    breadth first, so links grow with the rows and not with their square.
    """
    rows = signatures(distinct, max_bits)
    rows = rows.repartition("sig", "value").sortWithinPartitions("sig", "value")
    return rows.mapInArrow(_linker(max_bits), "fa long, fb long")


def near_duplicates(docs, shingle_words=SHINGLE_WORDS, max_bits=MAX_BITS):
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Equal fingerprints are one node, so copies cost one row each. component_id
    is the smallest doc_id that can be reached over links of at most max_bits
    differing bits. Null and blank texts share fingerprint 0 and are linked
    like any other. doc_id identifies a document: rows that repeat an id are
    one node of the graph. Rows without doc_id link others but never name a
    component; a component of such rows alone has a null id. An empty table
    gives no rows; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, shingle_words), "simhash")
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    # Two fingerprints of one repeated doc_id belong together as well.
    ids = prints.filter("doc_id is not null").distinct()
    repeated = ids.groupBy("doc_id").agg(
        F.min("fingerprint").alias("fa"), F.max("fingerprint").alias("last")).filter("fa != last")
    same = ids.join(repeated, "doc_id").select("fa", F.col("fingerprint").alias("fb"))
    found = links(distinct.select("fingerprint"), max_bits).unionByName(same)
    rooted = components.components(found.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    nodes = distinct.join(rooted, distinct.fingerprint == rooted.node, "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    lowest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(lowest, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs, shingle_words=SHINGLE_WORDS, max_bits=MAX_BITS):
    """The documents without all but one of each near-duplicate group.

    The document with the smallest doc_id stays. Of rows that repeat its id the one with
    the smallest hash of all its columns stays, whatever their order. Rows without doc_id belong to no
    group that could be named and stay. Texts are only shuffled if the list of the
    ids that go is measured to be beyond the broadcast limit.
    """
    groups = materialise(near_duplicates(docs, shingle_words, max_bits).select("doc_id", "component_id").filter(
        "doc_id is not null"), "simhash-groups")
    ids = groups.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    ids = materialise(ids.filter("n > 1 or doc_id != component_id").select("doc_id", "component_id"), "simhash-ids")
    small = fits_broadcast(ids)
    listed = lambda rows: F.broadcast(rows.select("doc_id")) if small else rows.select("doc_id")
    alone = docs.join(listed(ids), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(listed(ids.filter("doc_id = component_id")), "doc_id", "left_semi").select(
        F.struct(*docs.columns).alias("row"), F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit("second"), *docs.columns)).alias("place"))
    one = repeated.groupBy("row.doc_id").agg(F.min_by("row", "place").alias("row"))
    return alone.unionByName(one.select("row.*"))
