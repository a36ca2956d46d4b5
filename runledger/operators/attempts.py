"""Task-attempt logs: run time, outcome, spills and transfers of every attempt."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger.functions.text import log_timestamp
from runledger.operators.ordering import chunk_of
from runledger.session import fits_broadcast, materialise

# Attempt ids, the phrases that decide an outcome, its two names.
ATTEMPT = r"attempt_(\d+_\d+)_([mr])_(\d+)_(\d+)"
COMMITTING = ("is done", "And is in the process of commiting")
SAVED = ("FileOutputCommitter", "Saved output of task")
FINISHED = ("TaskRunner", "done")
CLEANUP = "processName=CLEANUP"
SPILL = r"Finished spill (\d+)"
TRANSFER = "Shuffling|Read|Failed"
SUCCESSFUL = "SUCCESSFUL"
FAILED = "FAILED|KILLED"

LINES_PER_CHUNK = 1 << 20


def _holds(words):
    found = F.col("line").contains(words[0])
    for word in words[1:]:
        found = found & F.col("line").contains(word)
    return found


def _info():
    return F.col("line").contains("INFO")


def with_attempt_parts(df):
    attempt = F.col("attempt_id")
    return df.select(
        "*", F.concat(F.lit("job_"), F.regexp_extract(attempt, ATTEMPT, 1)).alias("job_id"),
        F.regexp_extract(attempt, ATTEMPT, 2).alias("phase"),
        F.regexp_extract(attempt, ATTEMPT, 3).cast("long").alias("task"),
        F.regexp_extract(attempt, ATTEMPT, 4).cast("int").alias("try_no"))


def attempts_of(lines, job_id, phase=None):
    """Lines of one job, of one phase or both; the `job_` in front is optional."""
    prefix = f"attempt_{job_id.removeprefix('job_')}_"
    return lines.filter(F.col("attempt_id").startswith(prefix + (f"{phase}_" if phase else "")))


def logs_for_runs(lines, jobs):
    """Lines of the listed jobs only."""
    job = F.concat(F.lit("job_"), F.regexp_extract("attempt_id", ATTEMPT, 1))
    # Written once: the list is measured and joined.
    wanted = materialise(jobs.select("job_id").filter(F.col("job_id").isNotNull()).distinct(), "wanted-jobs")
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    return lines.withColumn("job_id", job).join(wanted, "job_id", "left_semi").select(
        *lines.columns)


def shuffle_transfers(lines, job_id=None):
    """Transfer lines of reduce attempts."""
    chosen = attempts_of(lines, job_id, "r") if job_id else lines.filter(
        F.regexp_extract("attempt_id", ATTEMPT, 2) == "r")
    return chosen.filter(F.col("line").rlike(TRANSFER))


def _facts(lines):
    """One row per attempt: first and last time stamp and the flags seen.

    A flag counts from the second line on, that is, when the last line that
    carries it lies behind the first line. All buffers are numbers, so the
    whole log collapses in one hash aggregation that combines before the
    shuffle, however long a single log is.
    """
    own = F.col("line").contains(F.col("attempt_id")) & _info()
    is_map = F.col("attempt_id").contains("_m_")
    committing = own & _holds(COMMITTING)
    finished = own & _holds(FINISHED)
    commit = F.when(is_map, committing).otherwise(own & _holds(SAVED))
    done = F.when(is_map, finished & ~committing).otherwise(finished)
    flags = {"commit": commit, "done": done,
             "cleanup": _info() & F.col("line").contains(CLEANUP),
             "spill": _info() & F.col("line").rlike(SPILL)}
    marked = lines.select(
        "host", "attempt_id", "line_no", log_timestamp(F.col("line")).alias("ts"),
        *[F.when(test, F.col("line_no")).alias(name) for name, test in flags.items()])
    facts = marked.groupBy("host", "attempt_id").agg(
        F.min("line_no").alias("first_no"),
        F.min_by("ts", "line_no").alias("started"), F.max_by("ts", "line_no").alias("ended"),
        *[F.max(name).alias(name) for name in flags])
    seen = [F.coalesce(F.col(name) > F.col("first_no"), F.lit(False)).alias(name)
            for name in flags]
    return facts.select("host", "attempt_id", "started", "ended", *seen)


def _timed(facts):
    return facts.filter(F.col("started").isNotNull() & F.col("ended").isNotNull()).withColumn(
        "seconds", F.unix_timestamp("ended") - F.unix_timestamp("started"))


def _outcome(success):
    return F.when(success, SUCCESSFUL).otherwise(FAILED)


def _success():
    is_map = F.col("attempt_id").contains("_m_")
    by_map = ~F.col("cleanup") & F.col("commit") & F.col("done") & F.col("spill")
    return F.when(is_map, by_map).otherwise(F.col("commit") & F.col("done"))


def attempt_times(lines):
    """Run time and outcome of all attempts, both phases in one pass."""
    attempts = with_attempt_parts(_timed(_facts(lines)))
    return attempts.withColumn("status", _outcome(_success())).select(
        "host", "attempt_id", "job_id", "phase", "seconds", "status",
        ((F.col("phase") == "r") & _success() & F.col("cleanup")).alias("cleanup_conflict"))


def map_attempt_times(lines):
    maps = lines.filter(F.col("attempt_id").contains("_m_"))
    return _timed(_facts(maps)).select(
        "host", "attempt_id", "seconds", _outcome(_success()).alias("status"))


def reduce_attempt_times(lines):
    """As for maps; a success that also cleaned up is marked as a conflict."""
    reduces = lines.filter(F.col("attempt_id").contains("_r_"))
    return _timed(_facts(reduces)).select(
        "host", "attempt_id", "seconds", _outcome(_success()).alias("status"),
        (_success() & F.col("cleanup")).alias("cleanup_conflict"))


def attempt_rejects(lines, files=None):
    """Attempts that give no row: an empty log, or no time on its first or last line.

    Empty files have no lines. Pass a listing of the storage with the columns
    host, attempt_id and length to see them as well.
    """
    facts = _facts(lines)
    rejects = facts.select(
        "host", "attempt_id",
        F.when(F.col("started").isNull(), "no time on the first line")
        .when(F.col("ended").isNull(), "no time on the last line").alias("reason"),
    ).filter(F.col("reason").isNotNull())
    if files is not None:
        rejects = rejects.unionByName(files.filter(F.col("length") == 0).select(
            "host", "attempt_id", F.lit("empty log").alias("reason")))
    return rejects


def report_line(attempt_id="attempt_id", seconds="seconds", status="status"):
    return F.format_string("%s,%6d, %s", F.col(attempt_id), F.col(seconds), F.col(status))


def job_summary(attempts):
    """Attempts, outcomes and run times per job and phase."""
    return attempts.groupBy("job_id", "phase").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == SUCCESSFUL).alias("successes"),
        F.count_if(F.col("status") != SUCCESSFUL).alias("failures"),
        F.min("seconds").alias("min_seconds"), F.avg("seconds").alias("avg_seconds"),
        F.max("seconds").alias("max_seconds"))


def spill_gaps(lines, chunk_width=LINES_PER_CHUNK):
    """Spill lines whose number is not the previous one plus 1, starting at 0.

    The first line of a log is not looked at, and after a gap counting goes on
    from the number that was seen. Logs are cut in chunks of line numbers: each
    chunk compares its own neighbours and learns the last spill before it from
    a small table of chunks, so a very long log is shared by many tasks.
    """
    attempt = ["host", "attempt_id"]
    spill = F.regexp_extract("line", SPILL, 1)
    marked = lines.select(
        *attempt, "line_no", chunk_of("line_no", chunk_width).alias("chunk"),
        F.when(_info() & (spill != ""), spill).try_cast("long").alias("spill"))
    chunks = marked.groupBy(*attempt, "chunk").agg(
        F.min("line_no").alias("chunk_first"),
        F.max(F.when(F.col("spill").isNotNull(), F.col("line_no"))).alias("last_no"),
        F.max_by("spill", F.when(F.col("spill").isNotNull(), F.col("line_no"))).alias("last"))
    whole = Window.partitionBy(*attempt)
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("first_no", F.min("chunk_first").over(whole)).withColumn(
        "last", F.when(F.col("last_no") > F.col("first_no"), F.col("last")))
    chunks = chunks.select(
        *attempt, "chunk", "first_no",
        F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    # A merge join leaves the spills partitioned as the window below needs them.
    spills = marked.filter(F.col("spill").isNotNull()).join(
        chunks.hint("merge"), [*attempt, "chunk"]).filter(
        F.col("line_no") > F.col("first_no"))
    order = Window.partitionBy(*attempt, "chunk").orderBy("line_no")
    previous = F.coalesce(F.lag("spill").over(order), F.col("carried"), F.lit(-1))
    return spills.withColumn("expected", previous + 1).filter(
        F.col("spill") != F.col("expected")).select(*attempt, "line_no", "spill", "expected")


def latest_attempts(files):
    """Attempts with the newest log first."""
    return files.orderBy(F.desc("modified"), "host", "attempt_id")
