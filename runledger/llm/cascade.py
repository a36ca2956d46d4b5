"""Exact membership by a cascade of Bloom filters over a known universe of keys.

The first filter holds the listed keys. Keys of the universe that pass it without
being listed go to the second filter, listed keys that pass that one to the third,
and so on until nobody passes wrongly. A key is looked up level by level; the first
filter without it decides. For every key of the universe the answer is exact, and
neither side of the lookup is shuffled or joined.

Keys are spread over shards of at most about KEYS_PER_SHARD listed keys. A shard's
filters are one small broadcast: the rate of the first filter is chosen so that about
as many foreign keys pass it as there are listed ones, whatever the size of the
universe, and all later filters pass every other key.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.textops import mix
from runledger.session import materialise

KEYS_PER_SHARD = 1 << 22
NEXT_RATE = 0.5
MAX_LEVELS = 200

FILTER_SCHEMA = "shard int, level int, size long, probes int, bits binary"


def hash_pair(key):
    """Two independent 64-bit hashes of a text column, as a struct."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def _shard_of(h1, shards):
    return F.pmod(F.shiftright(h1, 20), F.lit(shards)).cast("int")


def _places(h1, h2, level, size, probes):
    """Bit places of keys in the filter of a level: one row per key."""
    salt = mix(np.array([level + 1], np.uint64))[0]
    first, step = mix(h1 ^ salt), mix(h2 + salt) | np.uint64(1)
    return (first[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def _holds(bits, h1, h2, level, size, probes):
    places = _places(h1, h2, level, size, probes)
    return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _numbers(column):
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)


def _filters(keys, level, shards, sizes):
    """One row per shard with keys: its filter. A shard's keys meet in one task, as a stream."""
    def run(batches):
        current, bits = None, None

        def row():
            size, probes = sizes[current]
            return pa.RecordBatch.from_pylist(
                [{"shard": current, "level": level, "size": size, "probes": probes, "bits": bits.tobytes()}],
                pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("size", pa.int64()), ("probes", pa.int32()),
                           ("bits", pa.binary())]))
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            h1, h2 = _numbers(batch.column("h1")), _numbers(batch.column("h2"))
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(shard))):
                if shard[a] != current:
                    if current is not None:
                        yield row()
                    current = int(shard[a])
                    bits = np.zeros((sizes[current][0] + 7) // 8, np.uint8)
                places = np.unique(_places(h1[a:b], h2[a:b], level, *sizes[current]))
                np.bitwise_or.at(bits, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        if current is not None:
            yield row()
    placed = keys.select(_shard_of(F.col("h1"), shards).alias("shard"), "h1", "h2")
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FILTER_SCHEMA)


def _passing(keys, rows, shards):
    """The keys (h1, h2) that the filters of one level hold; a shard is broadcast at a time."""
    found = None
    for row in rows:
        shared = keys.sparkSession.sparkContext.broadcast(row.asDict())

        def run(batches, shared=shared):
            f = shared.value
            bits = np.frombuffer(f["bits"], np.uint8)
            for batch in batches:
                held = _holds(bits, _numbers(batch.column("h1")), _numbers(batch.column("h2")), f["level"], f["size"], f["probes"])
                yield batch.filter(pa.array(held))
        part = keys if shards == 1 else keys.filter(_shard_of(F.col("h1"), shards) == row["shard"])
        part = part.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")
        found = part if found is None else found.unionByName(part)
    return keys.select("h1", "h2").limit(0) if found is None else found


@dataclass
class Cascade:
    """Filters of all levels as a table, and the number of shards."""
    filters: DataFrame | None
    shards: int
    levels: int

    def _shard(self, number):
        rows = self.filters.filter(F.col("shard") == number).orderBy("level").collect()
        return [(r["level"], r["size"], r["probes"], bytes(r["bits"])) for r in rows]

    def mark(self, rows, pairs, name):
        """Rows with the array<boolean> `name`: whether each key of the array column `pairs` is listed.

        `pairs` is an array of hash pairs; a null array stays null. Shards beyond the
        first are further passes over the written rows.
        """
        if self.filters is None:
            return rows.withColumn(name, F.transform(pairs, lambda k: F.lit(False)))
        spark = rows.sparkSession
        for number in range(self.shards):
            looked_up = _lookup(spark.sparkContext.broadcast(self._shard(number)), number, self.shards)
            hits = looked_up(F.transform(pairs, lambda k: k["h1"]), F.transform(pairs, lambda k: k["h2"]))
            if number:
                hits = F.zip_with(name, hits, lambda a, b: a | b)
            rows = rows.withColumn(name, hits)
            if self.shards > 1:
                rows = materialise(rows, "cascade-rows")
        return rows


def _lookup(shared, number, shards):
    @F.arrow_udf("array<boolean>")
    def run(h1s: pa.Array, h2s: pa.Array) -> pa.Array:
        h1, h2 = _numbers(h1s.flatten()), _numbers(h2s.flatten())
        listed = np.zeros(len(h1), dtype=bool)
        mine = ((h1.view(np.int64) >> 20) % shards) == number
        levels = shared.value
        left = np.flatnonzero(mine)
        for depth, (level, size, probes, bits) in enumerate(levels):
            held = _holds(np.frombuffer(bits, np.uint8), h1[left], h2[left], level, size, probes)
            listed[left[~held]] = depth % 2 == 1
            left = left[held]
        listed[left] = len(levels) % 2 == 1
        bounds = np.concatenate([[0], np.cumsum(np.asarray(h1s.value_lengths().fill_null(0)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(listed), mask=h1s.is_null())
    return run


def _sizes(keys, shards, rate):
    """{shard: (bits, probes)} for the keys of a level; `rate` takes the number of a shard's keys."""
    counts = keys.groupBy(_shard_of(F.col("h1"), shards).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = {}
    for shard, n in counts:
        p = rate(n)
        found[shard] = (max(64, math.ceil(n * math.log2(1 / p) / math.log(2))), max(1, round(math.log2(1 / p))))
    return found


def build(listed, universe):
    """The cascade of the listed keys, exact for all keys of the universe; both are tables of h1, h2.

    Repeated keys and nulls do no harm, nor does a listed key outside the universe. No
    listed keys make a cascade that holds nothing. A key is known by its two hashes, 128 bits.
    """
    listed = materialise(listed.select("h1", "h2").na.drop().distinct(), "listed")
    n = listed.count()
    if n == 0:
        return Cascade(None, 0, 0)
    shards = math.ceil(n / KEYS_PER_SHARD)
    universe = universe.select("h1", "h2").na.drop()
    foreign = max(1, universe.agg(F.approx_count_distinct("h1")).first()[0]) / shards
    inside, outside, level, tables = listed, universe, 0, []
    while True:
        if level == MAX_LEVELS:
            raise RuntimeError(f"keys still pass wrongly after {MAX_LEVELS} levels")
        rate = (lambda k: min(NEXT_RATE, k / (math.sqrt(2) * foreign))) if level == 0 else (lambda k: NEXT_RATE)
        filters = materialise(_filters(inside, level, shards, _sizes(inside, shards, rate)), "filters")
        tables.append(filters)
        # A shard's filter at a time; each is bounded by KEYS_PER_SHARD.
        rows = (filters.filter(F.col("shard") == s).first() for s in range(shards))
        wrong = _passing(outside, (r for r in rows if r is not None), shards)
        if level == 0:
            wrong = wrong.distinct().join(listed, ["h1", "h2"], "left_anti")
        inside, outside = materialise(wrong, "passing"), inside
        level += 1
        if inside.isEmpty():
            break
    filters = tables[0]
    for table in tables[1:]:
        filters = filters.unionByName(table)
    return Cascade(materialise(filters, "cascade"), shards, level)
