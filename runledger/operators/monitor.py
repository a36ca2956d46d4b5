"""Host monitor captures: disk, CPU and memory samples and their summary.

A timed capture has the epoch second in front of every line, which moves all
tokens one place to the right.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger.functions.text import is_blank, tokens
from runledger.operators.ordering import chunk_of

# The marks that tell the line kinds apart, and the columns.
DEVICE = "sda2"
CPU_HEADER = "avg-cpu"
CPU_COLUMNS = "%user"
MEMORY_HEADER = "sw"
DISK = ["mb_read", "mb_write"]
CPU = ["user", "nice", "system", "iowait", "steal", "idle"]
MEMORY = ["swpd", "free", "buff", "cache"]

LINES_PER_CHUNK = 1 << 20
SKETCH_K = 1024


def _numbers(names, first, kind, timed):
    """Typed tokens of a line, counted from 1, and the time stamp of a timed one."""
    shift = 1 if timed else 0
    words = tokens(F.col("line"))
    values = [F.get(words, F.lit(first - 1 + shift + i)).try_cast(kind).alias(name)
              for i, name in enumerate(names)]
    if timed:
        second = F.get(words, F.lit(0)).try_cast("long")
        values.insert(0, F.timestamp_seconds(second).alias("ts"))
    return values


def _complete(samples, names):
    for name in names:
        samples = samples.filter(F.col(name).isNotNull())
    return samples


def _kept(lines, *dropped):
    return [c for c in lines.columns if c not in dropped]


def disk_samples(lines, device=DEVICE, timed=False):
    """MB read and written per second of one device."""
    found = lines.filter(F.col("line").contains(device))
    samples = found.select(*_kept(lines, "line"), *_numbers(DISK, 3, "double", timed))
    return _complete(samples, DISK)


def memory_samples(lines, timed=False):
    """Swap, free, buffer and cache sizes; header and blank lines give no row."""
    found = lines.filter(~F.col("line").contains(MEMORY_HEADER) & ~is_blank(F.col("line")))
    samples = found.select(*_kept(lines, "line"), *_numbers(MEMORY, 3, "long", timed))
    return _complete(samples, MEMORY)


def _cpu_values(lines, timed):
    """The line's first six tokens as numbers, NULL when one is missing or no number."""
    first = 2 if timed else 1
    line = F.col("line")
    # Only lines that start like a number are worth splitting.
    split = lines.withColumn("_words", F.when(line.rlike(r"^\s*[-+.0-9]"), tokens(line)))
    numbers = [F.get("_words", F.lit(first - 1 + i)).try_cast("double") for i in range(len(CPU))]
    parsed = split.withColumn("_cpu", F.when(F.col("_words").isNotNull(), F.array(*numbers)))
    complete = F.get("_cpu", F.lit(0)).isNotNull()
    for i in range(1, len(CPU)):
        complete = complete & F.get("_cpu", F.lit(i)).isNotNull()
    return parsed.withColumn("_cpu", F.when(complete, F.col("_cpu")))


def _cpu_columns(timed):
    named = [F.get("_cpu", F.lit(i)).alias(name) for i, name in enumerate(CPU)]
    return [F.col("_ts").alias("ts"), *named] if timed else named


def _line_time(timed):
    second = F.get("_words", F.lit(0)).try_cast("long") if timed else F.lit(None).cast("long")
    return F.timestamp_seconds(second).alias("_ts")


def cpu_report_samples(reports, timed=False):
    """The line after every CPU header, from captures that are cut at the headers.

    The text in front of the first header of a file carries no column names and
    gives no row, nor does a line that is not six numbers.
    """
    first = 1 if timed else 0

    def words_of(parts):
        line = F.get(parts, F.lit(1))
        # Only lines that start like a number are worth splitting.
        return F.when(F.get(parts, F.lit(0)).contains(CPU_COLUMNS) & line.rlike(r"^\s*[-+.0-9]"), tokens(line))

    def sample(words):
        values = [F.get(words, F.lit(first + i)).try_cast("double").alias(name) for i, name in enumerate(CPU)]
        if timed:
            values.insert(0, F.timestamp_seconds(F.get(words, F.lit(0)).try_cast("long")).alias("ts"))
        return F.struct(*values)

    def complete(cells):
        whole = F.lit(True)
        for name in CPU:
            whole = whole & cells[name].isNotNull()
        return whole

    # Arrays of one: each step is computed once for all its uses, and a filter behind
    # the generator cannot be pushed in front of it and split every line again.
    parts = F.array(F.split("report", "\r?\n", 3))
    words = F.filter(F.transform(parts, words_of), lambda w: w.isNotNull())
    samples = F.filter(F.transform(words, sample), complete)
    return reports.select(*_kept(reports, "report"), F.inline(samples))


def cpu_samples(lines, timed=False, chunk_width=LINES_PER_CHUNK):
    """The line after every CPU header; lines that are not six numbers give no row.

    For lines that are in a table already. Files are better read cut at the
    headers, see cpu_report_samples, which needs no shuffle.

    A capture is cut in chunks of line numbers, so a host that holds most of the
    lines is shared by many tasks. Inside a chunk a window finds the next line.
    A header that ends its chunk takes the first line of the next one: the first
    and last lines of all chunks, two per chunk, go through a second window.
    Both read the same shuffled lines.
    """
    source = ["host", "capture"]
    parsed = _cpu_values(lines, timed).select(
        *source, "line_no", chunk_of("line_no", chunk_width).alias("_chunk"),
        F.col("line").contains(CPU_HEADER).alias("_header"),
        F.struct("line_no", _line_time(timed), "_cpu").alias("_own"))
    inside = Window.partitionBy(*source, "_chunk").orderBy("line_no")
    rows = parsed.withColumn("_next", F.lead("_own").over(inside)).withColumn(
        "_first", F.lag("_own").over(inside).isNull())
    across = Window.partitionBy(*source).orderBy("line_no")
    ends = rows.filter(F.col("_first") | F.col("_next").isNull()).withColumn(
        "_after", F.lead("_own").over(across))
    pairs = rows.filter(F.col("_header") & F.col("_next").isNotNull()).select(
        *source, "_next").unionByName(
        ends.filter(F.col("_header") & F.col("_next").isNull()).select(
            *source, F.col("_after").alias("_next")))
    found = pairs.filter(F.col("_next._cpu").isNotNull())
    return found.select(*source, "_next.*").select(*source, "line_no", *_cpu_columns(timed))


def sketches(metrics, k=SKETCH_K):
    """Mergeable quantile sketches of the metrics, as aggregates named `sketch_<metric>`.

    A sketch keeps every value of up to about k samples; beyond, ranks are off by
    about 2 / k of the samples, and its size grows with the logarithm of their number.
    """
    return [F.kll_sketch_agg_double(F.col(name).cast("double"), F.lit(k)).alias(f"sketch_{name}") for name in metrics]


def quantiles(metrics, share=0.95):
    """The percentile of each metric from its sketch, as columns named `p95_<metric>`; NULL without samples."""
    def of(name):
        sketch = F.col(f"sketch_{name}")
        # A sketch without values has no quantile.
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))
    return [of(name).alias(f"p{round(share * 100)}_{name}") for name in metrics]


def merged_windows(windows, metrics, unit, k=SKETCH_K):
    """Samples and sketches per host and longer window, from those of the windows in it.

    `unit` is what date_trunc takes, as day. The samples themselves are not read again.
    """
    merged = [F.kll_merge_agg_double(f"sketch_{name}", F.lit(k)).alias(f"sketch_{name}") for name in metrics]
    return windows.groupBy(F.date_trunc(unit, "window_start").alias("window_start"), "host").agg(
        F.sum("samples").alias("samples"), *merged)


def monitor_summary(samples, metrics, share=0.95, accuracy=10000):
    """Samples, mean, peak and a high percentile of every metric per host."""
    measures = [F.count(F.lit(1)).alias("samples")]
    for name in metrics:
        measures += [
            F.avg(name).alias(f"avg_{name}"), F.max(name).alias(f"max_{name}"),
            F.percentile_approx(name, share, accuracy).alias(f"p{round(share * 100)}_{name}")]
    return samples.groupBy("host").agg(*measures)
