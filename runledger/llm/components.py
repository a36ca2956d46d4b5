"""Connected components by star contraction, each round a written table."""

from pyspark.sql import functions as F

from runledger.session import materialise

MAX_ROUNDS = 64


def _state(links):
    row = links.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links):
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Large-star and small-star rounds hang every neighbourhood under its
    minimum until nothing moves; the depth falls geometrically. Minima are
    combined before the shuffle and the joins are plain equality joins, so a
    hub is split like any skewed key. Nulls are no nodes; loops and repeated
    links do no harm; no links give no rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        F.col("a") != F.col("b")).distinct()
    pairs = materialise(pairs, "links")
    state = _state(pairs)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = pairs.join(lowest, pairs.b == lowest.k).select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, large.a == least.k).select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialise(
            small.filter(F.col("a") != F.col("b")).unionByName(
                least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
