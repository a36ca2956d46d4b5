"""Exact ranges of an id: the same cuts for the same rows, whatever the cluster."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runledger.operators.ordering import number_rows

LOWEST = -(1 << 63)


def key_of(column):
    """The id to sort by; a missing id sorts before all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LOWEST).cast("long"))


def cuts(df, column, rows_per_range):
    """(lowest id, highest id) of ranges with about rows_per_range rows each, in order.

    The ids are numbered by a distributed sort; only the ids at the cuts reach
    the driver. Rows with equal ids always share a range.
    """
    ids, total = number_rows(df.select(key_of(column).alias("k")), ["k"], start=0, collapse_copies=False)
    at = F.col("ordinal") % rows_per_range
    edge = ids.filter((at == 0) | (at == rows_per_range - 1) | (F.col("ordinal") == total - 1))
    rows = sorted((r["ordinal"], r["k"]) for r in edge.collect())
    lows = sorted({k for ordinal, k in rows if ordinal % rows_per_range == 0})
    every = sorted(k for _, k in rows)
    highs = [every[int(np.searchsorted(every, nxt, "left")) - 1] for nxt in lows[1:]] + every[-1:]
    return lows, highs[:len(lows)]


def range_of(key, lows):
    """Number of the range of a key column, by binary search."""
    edges = np.array(lows, np.int64)

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            found = np.searchsorted(edges, np.asarray(keys, np.int64), "right") - 1
            yield pa.array(np.maximum(found, 0).astype(np.int32))
    return F.arrow_udf(place, "int")(key)


def is_highest(key, highs):
    """Whether a key is the highest of its range."""
    edges = np.array(highs or [0], np.int64)

    def there(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            keys = np.asarray(keys, np.int64)
            found = np.minimum(np.searchsorted(edges, keys), len(edges) - 1)
            yield pa.array(edges[found] == keys)
    return F.arrow_udf(there, "boolean")(key)
