"""Total order, distributed row numbers and running totals without a one-task window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger.session import materialise, scratch_path, shuffle_partitions

COPIES_PER_ROW = 1 << 16
_RECORD_BITS = (1 << 33) - 1


def chunk_of(column, width):
    """Number of the chunk of `width` consecutive values that a whole number falls in."""
    return F.call_function("div", F.col(column), F.lit(width))


def _keys(keys):
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def fold_copies(df):
    """Equal rows become one row with a count, so that no task gets all copies.

    The count is combined before the shuffle. Rows with very many copies are
    cut in blocks, which a later partitioning may put in different tasks.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.sequence(F.lit(0).cast("long"), F.call_function(
        "div", F.col("_n") - 1, F.lit(COPIES_PER_ROW)))
    return counted.withColumn("_block", F.explode(blocks)).withColumn(
        "_n", F.least(F.lit(COPIES_PER_ROW).cast("long"),
                      F.col("_n") - F.col("_block") * COPIES_PER_ROW))


def unfold_copies(rows):
    """One row per copy again."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))


def total_sort(df, keys, partitions=None, collapse_copies=True, from_files=False):
    """All rows in the order of the keys over `partitions` sorted ranges.

    Ties are broken, so one key that holds a large share of the rows is spread
    over several ranges. With from_files, for rows straight from parquet files,
    the place in the file does it: it is the same on every attempt and tells
    copies apart, so there is one shuffle. Else it is a hash of the whole row,
    and whole-row copies, which no hash can tell apart, are folded first. Pass
    collapse_copies=False for rows known to be distinct: it saves that shuffle.
    """
    columns = df.columns
    n = partitions or shuffle_partitions(df.sparkSession)
    order = [*_keys(keys), F.col("_tie")]
    if from_files:
        order.append(F.col("_row"))
        placed = df.select("*", F.xxhash64("_metadata.file_path").alias("_tie"), F.col("_metadata.row_index").alias("_row"))
        return placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*columns)
    rows = df
    if collapse_copies:
        rows = fold_copies(df)
        order.append(F.col("_block"))
    rows = rows.withColumn("_tie", F.xxhash64(*columns))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return (unfold_copies(rows) if collapse_copies else rows).select(*columns)


def _placed(df, keys, partitions, collapse_copies, from_files=False):
    """Sorted rows, written once, with range number, place in the range and range sizes.

    Range bounds come from a sample, so a second run could cut elsewhere.
    Writing the rows fixes them, also against lost executors, and counting then
    reads one narrow column.
    """
    spark = df.sparkSession
    ranged = total_sort(df, keys, partitions, collapse_copies, from_files).select(
        "*", F.spark_partition_id().alias("_range"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_RECORD_BITS)).alias("_place"))
    path = scratch_path(spark, "ordinal")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    # At most one row per range reaches the driver.
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
    return rows, sizes


def number_rows(df, keys, name="ordinal", start=1, partitions=None, collapse_copies=True, from_files=False):
    """Like with_ordinal, and the row count beside it."""
    rows, sizes = _placed(df, keys, partitions, collapse_copies, from_files)
    before, starts = start, []
    for number in range(max(sizes, default=-1) + 1):
        starts.append(str(before))
        before += sizes.get(number, 0)
    offsets = F.split(F.lit(",".join(starts) or "0"), ",").cast("array<bigint>")
    ordinal = F.get(offsets, F.col("_range")) + F.col("_place")
    return rows.select(*df.columns, ordinal.alias(name)), before - start


def with_ordinal(df, keys, name="ordinal", start=1, partitions=None, collapse_copies=True, from_files=False):
    """Number the rows start, start + 1, ... in the order of the keys.

    Rows that tie on all keys are numbered in an unspecified order.
    """
    return number_rows(df, keys, name, start, partitions, collapse_copies, from_files)[0]


def running_total(df, order, weight, name):
    """Sum of `weight` over all earlier rows of a table, as a table that is written once.

    The rows are cut in sorted ranges. Sums inside a range are a window over the
    range; the sums of the ranges, one number each, meet on the driver.
    """
    rows = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).select(
        "*", F.spark_partition_id().alias("_range"))
    rows = materialise(rows, "running")
    sums = {r["_range"]: r["total"] for r in rows.groupBy("_range").agg(F.sum(weight).alias("total")).collect()}
    before, starts = 0, []
    for number in range(max(sums, default=-1) + 1):
        starts.append(str(before))
        before += sums.get(number, 0)
    offsets = F.split(F.lit(",".join(starts) or "0"), ",").cast("array<bigint>")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.get(offsets, F.col("_range")) + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return rows.withColumn(name, total.cast("long")).drop("_range")


def running_before(df, chunk, order, weight, name, group):
    """Sum of `weight` over all earlier rows of the group, in two levels.

    `chunk` must not fall as `order` grows. Rows are summed inside their chunk,
    the chunk totals are summed over the chunks before, and both are added, so
    the longest task sees one chunk or one group's list of chunks.
    """
    group = list(group)
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = df.withColumn("_chunk", chunk)
    totals = rows.groupBy(*group, "_chunk").agg(F.sum(weight).alias("_total"))
    totals = totals.select(
        *group, "_chunk", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    # The window left the rows partitioned and sorted for a merge join.
    return rows.join(totals.hint("merge"), [*group, "_chunk"]).withColumn(
        name, (F.col("_before") + F.col("_inside")).cast("long")
    ).drop("_chunk", "_before", "_inside")


def sort_stats(stats, columns, name=None, collapse_copies=True):
    """Ascending numeric order over several columns; text that is no number sorts first.

    With a name the rows are also numbered from 1, in the same sort.
    """
    keys = [F.col(c).try_cast("double") for c in columns]
    if name:
        return with_ordinal(stats, keys, name, collapse_copies=collapse_copies)
    return total_sort(stats, keys, collapse_copies=collapse_copies)
