"""Equi-joins that name their keys by column position."""

from pyspark.sql import functions as F

from runledger.operators.ordering import fold_copies, unfold_copies
from runledger.session import BROADCAST_LIMIT, fits_broadcast

STRATEGIES = ("merge", "broadcast", "salted")


def _key(df, position):
    if not 1 <= position <= len(df.columns):
        raise ValueError(f"column {position} does not exist, there are {len(df.columns)}")
    return df.columns[position - 1]


def hot_keys(df, key, salts):
    """At most 4 * salts values of a column, among them all that more than one row in `salts` has.

    One pass with a mergeable sketch of frequent items. It keeps at least 64 counters
    a salt; their counts are too low by at most 3.5 / 64 of a hot key's smallest count, and
    it reports whatever it has counted beyond that error, most frequent first. Fewer than
    2 * salts values can be counted as high as a hot one, so none of those is cut off.
    """
    counters = max(1024, 64 * salts)
    top = F.call_function("approx_top_k", F.col(key), F.lit(4 * salts), F.lit(counters))
    found = df.filter(F.col(key).isNotNull()).agg(top.alias("top")).first()["top"]
    return [item["item"] for item in found or []]


def join_by_position(left, left_column, right, right_column, strategy="merge",
                     limit=BROADCAST_LIMIT, salts=16, n=None):
    """Inner join on the 1-based columns of both sides.

    merge      shuffles and sorts both sides; skewed partitions of either side
               are split at run time by adaptive execution. With `n`, both sides are
               dealt to exactly n reducers, and nothing is split.
    broadcast  sends the left side to every task, if its measured size is within
               `limit`; beyond it this is the merge join.
    salted     splits the hot keys of the right side, those with more than one
               row in `salts` and perhaps some more that a sketch finds in one pass,
               over `salts` partitions and repeats their left rows. Whole-row copies, which would get the same salt, are folded
               before and unfolded after the join. All other keys take the
               merge join, neither folded nor repeated.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown join strategy {strategy!r}")
    if n is not None and (strategy != "merge" or n < 1):
        raise ValueError("a number of reducers, at least 1, belongs to the merge join")
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    a, b = _key(left, left_column), _key(right, right_column)
    condition = F.col(a) == F.col(b)
    if strategy == "broadcast" and fits_broadcast(left, limit):
        return F.broadcast(left).join(right, condition).select(*left.columns, *right.columns)
    if strategy == "salted":
        hot = F.array(*[F.lit(k) for k in hot_keys(right, b, salts)]).cast(f"array<{right.schema[b].dataType.simpleString()}>")
        is_hot = lambda column: F.coalesce(F.array_contains(hot, F.col(column)), F.lit(False))
        cold = left.hint("merge").join(right.filter(~is_hot(b)), condition)
        spread = fold_copies(right.filter(is_hot(b))).withColumn(
            "_r", F.pmod(F.xxhash64(*right.columns, "_block"), F.lit(salts)).cast("int"))
        repeated = left.filter(is_hot(a)).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = unfold_copies(repeated.hint("merge").join(spread, condition & (F.col("_l") == F.col("_r"))))
        columns = [*left.columns, *right.columns]
        return cold.select(*columns).unionByName(salted.select(*columns))
    sides = (left.repartition(n, a), right.repartition(n, b)) if n else (left, right)
    return sides[0].hint("merge").join(sides[1], condition).select(*left.columns, *right.columns)
