"""Seeded hash columns: the same row gets the same value on every attempt."""

import math

from pyspark.sql import functions as F

HEAD = 64


def uniform(seed, *columns):
    """A number in [0, 1) with 53 random bits, a pure function of its columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def pick(seed, low, high, *columns):
    """A whole number in [low, high]."""
    return (F.lit(low) + F.floor(uniform(seed, *columns) * (high - low + 1))).cast("long")


def _area(x, z):
    return math.log(x) if z == 1 else x ** (1.0 - z) / (1.0 - z)


def _sum_to(x, z):
    """Column that differs from the sum of rank ** -z over the ranks below x by a constant.

    x is half-way between two ranks. These are the first terms of the midpoint
    summation formula; beyond HEAD the ones left out are below 1e-13.
    """
    slope = -z * F.pow(x, -(z + 1.0))
    third = -z * (z + 1.0) * (z + 2.0) * F.pow(x, -(z + 3.0))
    area = F.log(x) if z == 1 else F.pow(x, 1.0 - z) / (1.0 - z)
    return area - slope / 24 + third * 7 / 5760


def _sum_at(x, z):
    slope = -z * x ** -(z + 1.0)
    third = -z * (z + 1.0) * (z + 2.0) * x ** -(z + 3.0)
    return _area(x, z) - slope / 24 + third * 7 / 5760


def _search(u, cumulative, first, last):
    """Balanced comparison tree for the first rank whose cumulative share exceeds u."""
    if first == last:
        return F.lit(first + 1).cast("long")
    middle = (first + last) // 2
    return F.when(u < cumulative[middle], _search(u, cumulative, first, middle)).otherwise(
        _search(u, cumulative, middle + 1, last))


def zipf_rank(u, n_keys, z):
    """The first rank whose cumulative share exceeds u, for shares proportional to rank ** -z.

    Shares are sums over all ranks, whatever their number. The first ones are
    compared one by one; sums beyond them have a closed form that is exact to
    rounding, so a key space of any size needs neither a table nor a join.
    """
    if not 0 <= z <= 4:
        raise ValueError("the zipf factor must be between 0 and 4")
    if n_keys < 1:
        raise ValueError("at least one key is needed")
    if z == 0:
        return F.least(F.floor(u * n_keys) + 1, F.lit(n_keys)).cast("long")
    z = float(z)
    head = min(HEAD, n_keys)
    weights = [k ** -z for k in range(1, head + 1)]
    tail = _sum_at(n_keys + 0.5, z) - _sum_at(head + 0.5, z) if n_keys > head else 0.0
    total = sum(weights) + tail
    cumulative, share = [], 0.0
    for weight in weights:
        share += weight / total
        cumulative.append(share)
    in_head = _search(u, cumulative, 0, head - 1)
    if n_keys == head:
        return in_head
    wanted = (u - cumulative[-1]) * total + _sum_at(head + 0.5, z)
    x = F.exp(wanted) if z == 1 else F.pow(F.greatest(wanted * (1.0 - z), F.lit(1e-300)), 1.0 / (1.0 - z))
    # The area alone is off by less than one rank: the sums on both sides settle it.
    near = F.greatest(F.floor(x + 0.5), F.lit(head + 1)).cast("double")
    rank = near + F.when(_sum_to(near + 0.5, z) <= wanted, 1).when(_sum_to(near - 0.5, z) > wanted, -1).otherwise(0)
    in_tail = F.least(F.greatest(rank, F.lit(head + 1)), F.lit(n_keys)).cast("long")
    return F.when(u < cumulative[-1], in_head).otherwise(in_tail)


def zipf_key(df, id_column, n_keys, z, seed=0, name="zipf_key"):
    return df.withColumn(name, zipf_rank(uniform(seed, F.col(id_column)), n_keys, z))


# Fixed values of the permutation: a prime below 2^31, multipliers, half rounds. All
# products stay below 2^63, so any SQL engine can check a place.
PRIME, SEED_STEP, GROUP_STEP, ROUND_STEP, MULTIPLIER = 2**31 - 1, 1_000_003, 8_191, 131_071, 48_271
HALF_ROUNDS = 6


def permuted(place, n, seed, group):
    """Image of 0 <= place < n under a permutation of 0 .. n - 1 that the seed and the group choose.

    A column expression: no row needs to know another one. The place is a row and a column
    of the smallest grid near a square that holds n cells; half rounds move the row by a hash of
    the column and the column by a hash of the row, each of which can be undone. A place that leaves
    0 .. n - 1, one of about the square root of n, is moved on until it is back; there are fewer
    cells beyond n than rows, which bounds the steps.
    """
    div = lambda a, b: F.call_function("div", a, b)
    n = n.cast("long")
    rows = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    columns = div(n + rows - 1, rows)
    key = (F.pmod(seed.cast("long"), F.lit(PRIME)) * SEED_STEP + F.pmod(group.cast("long"), F.lit(PRIME)) * GROUP_STEP)

    def hashed(value, number):
        mixed = (value + (key + number * ROUND_STEP) % PRIME) % PRIME
        return (mixed * mixed % PRIME * MULTIPLIER + key) % PRIME

    def half_round(cell, number):
        by_row = F.struct(((cell["row"] + hashed(cell["column"], number)) % rows).alias("row"), cell["column"].alias("column"))
        by_column = F.struct(cell["row"].alias("row"), ((cell["column"] + hashed(cell["row"], number)) % columns).alias("column"))
        return F.when(number % 2 == 0, by_row).otherwise(by_column)

    def moved(x):
        cell = F.struct(div(x, columns).alias("row"), (x % columns).alias("column"))
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(HALF_ROUNDS - 1).cast("long"))
        return F.aggregate(numbers, cell, half_round, lambda c: c["row"] * columns + c["column"])

    def inside(x):
        return F.when(x < n, x).otherwise(
            F.aggregate(F.sequence(F.lit(1).cast("long"), rows), x, lambda y, _: F.when(y < n, y).otherwise(moved(y))))
    return F.get(F.transform(F.array(moved(place.cast("long"))), inside), F.lit(0))
