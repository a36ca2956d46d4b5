"""Sequence packing by shortest-pack-first over the histogram of piece lengths."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from runledger.llm import bpe, textops
from runledger.session import materialise

CAPACITY = 1024
END_ID = 0

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "task int, place long")


def cut(docs, tokenizer_path, capacity=CAPACITY, end_id=END_ID, with_ids=False):
    """Pieces of at most `capacity` ids of every row's text and its end id.

    `task` and `place` number the pieces of each length within a task.
    """
    def run(batches):
        task = TaskContext.get().partitionId()
        encoder = bpe.encoder(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        for chunk in textops.chunks(batches):
            flat, bounds = encoder.rows(chunk.column("text"))
            total = np.diff(bounds) + 1
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(chunk.num_rows), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(total[row] - start, capacity)
            ids = []
            for r, a, n in zip(row.tolist(), start.tolist(), length.tolist()):
                low, high = bounds[r] + a, min(bounds[r] + a + n, bounds[r + 1])
                piece = flat[low:high]
                ids.append(piece if len(piece) == n else np.append(piece, np.uint32(end_id)))
            order = np.argsort(length, kind="stable")
            sizes = length[order]
            firsts = np.searchsorted(sizes, sizes, "left")
            place = np.empty(len(row), np.int64)
            place[order] = seen[sizes] + np.arange(len(row)) - firsts
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [chunk.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(total[row]),
                       pa.array(np.full(len(row), task, np.int32)), pa.array(place)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def shortest_pack_first(histogram, capacity=CAPACITY):
    """[(lengths of a pack, number of such packs)] for {length: pieces}.

    Lengths are placed longest first, each into the open pack that is shortest
    so far and still has room. All pieces of one length move together, so the
    work depends on the number of lengths and patterns and not on the pieces.
    """
    room = [[] for _ in range(capacity + 1)]  # open patterns by the room they have left
    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], capacity
        while left:
            while space >= length and not room[space]:
                space -= 1
            if space < length:
                each = capacity // length  # nothing fits: new packs, each filled before the next
                if left >= each:
                    room[capacity - each * length].append(([length] * each, left // each))
                if left % each:
                    room[capacity - left % each * length].append(([length] * (left % each), 1))
                break
            pattern, count = room[space].pop()
            used = min(left, count)
            if count > used:
                room[space].append((pattern, count - used))
            room[space - length].append(([*pattern, length], used))
            left -= used
    return [found for patterns in room for found in patterns]


def slots(patterns):
    """Per length: (first rank, first sequence_id, offset) of every place for it, by rank."""
    taken, places, sequence = {}, {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            places.setdefault(length, []).append((rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return {length: np.array(rows, np.int64).T for length, rows in places.items()}


def _assign(places):
    def run(batches):
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, base, at = places[int(size)]
                slot = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = base[slot] + rank[rows] - first[slot]
                offset[rows] = at[slot]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"])
    return run


def pack(docs, tokenizer_path, capacity=CAPACITY, end_id=END_ID, with_ids=False):
    """Pieces of docs(doc_id, text) with their sequence and place in it.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids on demand. A text becomes its ids and the end id, cut every
    `capacity` ids; null text is empty and gives the end id alone. Repeated
    rows are packed each for itself; rows without doc_id too. An empty table
    gives no rows; other columns are ignored.

    Only the histogram of piece lengths, at most `capacity` numbers, reaches
    the driver, and only the patterns made of it go back to the tasks. A piece
    finds its pattern by its rank among the pieces of its length: its place in
    its task plus the pieces of that length in tasks before.
    """
    pieces = materialise(cut(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(shortest_pack_first(histogram, capacity))
    ranked = pieces.join(counts.select("task", "length", "before"), ["task", "length"]).withColumn(
        "rank", F.col("before") + F.col("place"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in [*names, "sequence_id", "offset"])
    return ranked.select(*names, "rank").mapInArrow(_assign(places), schema)


def sequences(packed, capacity=CAPACITY, pad_id=END_ID):
    """(sequence_id, ids, used): token sequences of pieces packed with their ids.

    Sequences are padded to the capacity, except those that are a power of two long.
    No pieces give no sequences; pieces that repeat a doc_id stand apart.
    """
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten("parts.ids")
    missing = F.when(F.bit_count(F.size(ids)) == 1, 0).otherwise(F.greatest(F.lit(0), F.lit(capacity) - F.size(ids)))
    padding = F.array_repeat(F.lit(pad_id), missing)
    return parts.select("sequence_id", F.concat(ids, padding).alias("ids"), F.size(ids).alias("used"))
