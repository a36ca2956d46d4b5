"""Text sources that keep file order: client logs, attempt logs, monitor captures."""

from pyspark.sql import functions as F

from runledger.session import conf_bytes, shared_listing
from runledger.sources.files import read_small_files

# How the three kinds of files are named.
RUN_PATTERN = r"(EXPT-\d+)"
# A log is the file syslog of its attempt, or the part files of a folder that Spark
# wrote as host=<host>/attempt_id=<attempt>.
ATTEMPT_PATTERN = r"(attempt_\d+_\d+_[mr]_\d+_\d+)/(?:syslog|part-)"
HOST_PATTERN = r"([^/=]+)(?:/userlogs)?/(?:attempt_id=)?attempt_\d+_\d+_[mr]_\d+_\d+/(?:syslog|part-)"
CAPTURE_PATTERN = r"(?:iostat|vmstat)_output-([^/]+)"
MONITOR_FILES = {"disk": "*iostat_output-*", "cpu": "*iostat_output-*",
                 "memory": "*vmstat_output-*"}

CPU_MARK = "avg-cpu:"

def line_number(spark):
    """A long that grows with the position of a line in its file.

    A file is read in splits that start at multiples of the split size, which is
    never below the smaller of the two settings read here. The number of the
    split goes to the upper bits and the record number inside the task (the
    lower 33 bits of monotonically_increasing_id) to the lower ones. A single
    long keeps min_by / max_by on it inside hash aggregation.
    """
    smallest = min(conf_bytes(spark, "spark.sql.files.maxPartitionBytes"),
                   conf_bytes(spark, "spark.sql.files.openCostInBytes"))
    split = F.floor(F.col("_metadata.file_block_start") / F.lit(max(smallest, 1)))
    record = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return split.cast("long") * F.lit(1 << 33) + record


def read_lines(spark, path, **columns):
    """One row per line: the given columns (patterns on the path), line_no, line."""
    with shared_listing(spark):
        lines = spark.read.text(path)
    tags = [F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias(name)
            for name, pattern in columns.items()]
    return lines.select(*tags, line_number(spark).alias("line_no"), F.col("value").alias("line"))


def read_file_lines(spark, path, **columns):
    """The rows of read_lines for trees of very many small files, which tasks list and read."""
    lines = read_small_files(spark, path, line_number(spark))
    tags = [F.regexp_extract(F.col("path"), pattern, 1).alias(name) for name, pattern in columns.items()]
    return lines.select(*tags, "line_no", F.col("value").alias("line"))


def read_text(spark, path):
    """Plain text corpus; lines carry no order, so the scan stays bare."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_client_logs(spark, path):
    """Job-client output of every run, tagged with the run in its directory name."""
    return read_lines(spark, path, expt_id=RUN_PATTERN).filter(F.col("expt_id") != "")


def read_attempt_logs(spark, path):
    """Task-attempt logs of every host: `<host>/[userlogs/]attempt_*/syslog`."""
    return read_file_lines(spark, path, host=HOST_PATTERN, attempt_id=ATTEMPT_PATTERN).filter(
        F.col("attempt_id") != "")


def attempt_glob(base, job_id=None, phase=None):
    """Path pattern of all attempt logs, or of one job or phase.

    Line numbers stand in the way of pushing a filter on the attempt into the
    scan, so a reader of few jobs should name them here: other files are then
    never opened.
    """
    job = job_id.removeprefix("job_") if job_id else "*"
    return f"{base.rstrip('/')}/*/attempt_{job}_{phase or '[mr]'}_*/syslog"


def attempt_files(spark, path):
    """One row per attempt log file with its size and time; contents are not read.

    Spark's file sources leave out empty files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.select(
        F.regexp_extract("path", HOST_PATTERN, 1).alias("host"),
        F.regexp_extract("path", ATTEMPT_PATTERN, 1).alias("attempt_id"),
        F.col("length"), F.col("modificationTime").alias("modified"),
    ).filter(F.col("attempt_id") != "")


def read_monitor(spark, directory, kind):
    """Captures of one kind below a directory, named after their host.

    A capture is a file, or a folder of files that each start with a new sample.
    """
    if kind not in MONITOR_FILES:
        raise ValueError(f"unknown monitor kind {kind!r}")
    return read_lines(
        spark, f"{directory.rstrip('/')}/{MONITOR_FILES[kind]}",
        host=CAPTURE_PATTERN, capture=r"([^/]+/[^/]+)$")


def cpu_reports(reader, directory):
    """Captures cut at every CPU header, from a batch or stream reader.

    A record starts right behind a header's mark and runs up to the next one,
    so the line after the header is in the same row and no order of lines is
    needed.
    """
    records = reader.option("lineSep", CPU_MARK).load(
        f"{directory.rstrip('/')}/{MONITOR_FILES['cpu']}")
    return records.select(
        F.regexp_extract(F.col("_metadata.file_path"), CAPTURE_PATTERN, 1).alias("host"),
        F.col("value").alias("report"))


def read_cpu_reports(spark, directory):
    return cpu_reports(spark.read.format("text"), directory)


PACKED = "expt_id string, file_name string, line_no long, line string, kind string"


def read_packed(spark, path, kind, expt_ids=None):
    """Lines of one kind out of packed artifacts, of all runs or of a short list of them.

    Other kinds are not opened; of the files of this kind only the row groups
    that may hold a listed run are read.
    """
    rows = spark.read.schema(PACKED).parquet(path).filter(F.col("kind") == kind)
    if expt_ids is None:
        return rows
    wanted = sorted(set(expt_ids))
    if not wanted:
        return rows.filter(F.lit(False))
    # The outer bounds reach the statistics whatever the length of the list.
    return rows.filter(F.col("expt_id").between(wanted[0], wanted[-1]) & F.col("expt_id").isin(wanted))


def read_artifacts(spark, base, kind):
    """Lines of one kind of artifact of every run: `<base>/EXPT-dddd/<kind>/<file>`.

    Folders that a partitioned writer named `kind=<kind>/file_name=<file>` are read alike.
    """
    return read_file_lines(spark, f"{base.rstrip('/')}/*EXPT-*/{{{kind},kind={kind}}}/*",
                           expt_id=RUN_PATTERN, file_name=r"([^/=]+)(?:/part-[^/]*)?$").withColumn("kind", F.lit(kind))
