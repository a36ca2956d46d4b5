"""Job-client logs: which jobs a run started and how long they took."""

from pyspark.sql import functions as F

from runledger.functions.text import client_timestamp
from runledger.session import materialise

NO_JOB = "Null"


def extract_job_ids(lines):
    """Every (run, job) announced by a `Running` line that ends in a job id."""
    job = F.regexp_extract("line", r"(job[0-9_]+)$", 1)
    return lines.filter(F.col("line").contains("Running")).select(
        "expt_id", job.alias("job_id")).filter(F.col("job_id").startswith("job_")).distinct()


def run_job_map(runs, ids):
    """One row per run and job; a run without a job stays with a NULL job.

    Two joins in place of one outer join: the side with the jobs is then always
    one that adaptive execution may split, should one run hold most of them. Both
    read the two narrow sides from tables that are written once.
    """
    ids = materialise(ids.select("expt_id", "job_id"), "job-ids")
    listed = materialise(runs.select("expt_id").distinct(), "listed-runs")
    started = ids.join(listed, "expt_id", "left_semi")
    idle = listed.join(ids, "expt_id", "left_anti")
    return started.unionByName(idle.withColumn("job_id", F.lit(None).cast("string")))


def job_run_times(lines):
    """Whole seconds from `Running job` to `Job complete`; NULL without an end line.

    Lines are combined before the shuffle, so a chatty run costs no more than
    its lines.
    """
    line = F.col("line")
    job = F.regexp_extract(line, r"(job_[0-9_]+)", 1)
    starts = line.contains("Running")
    ends = line.contains("complete") & line.contains("Job")
    events = lines.filter(starts | ends).select(
        "expt_id", job.alias("job_id"), client_timestamp(line).alias("ts"),
        starts.alias("starts"), ends.alias("ends")).filter(F.col("job_id") != "")
    return events.groupBy("expt_id", "job_id").agg(
        F.min(F.when(F.col("starts"), F.col("ts"))).alias("started"),
        F.max(F.when(F.col("ends"), F.col("ts"))).alias("ended"),
    ).filter(F.col("started").isNotNull()).withColumn(
        "seconds", F.unix_timestamp("ended") - F.unix_timestamp("started"))


def client_jobs(lines):
    """(expt_id, job_id, seconds) of every announced job, and one row without a job for a run that has none.

    What run_job_map and job_run_times say together, from one pass over the lines:
    a line gives the run itself, the job that it announces and the job that it
    times, and these are combined before the shuffle. The narrow result is written once.
    """
    line = F.col("line")
    starts, ends = line.contains("Running"), line.contains("complete") & line.contains("Job")
    announced = F.when(starts, F.regexp_extract(line, r"(job[0-9_]+)$", 1))
    timed = F.when(starts | ends, F.regexp_extract(line, r"(job_[0-9_]+)", 1))
    ts = F.when(starts | ends, client_timestamp(line))
    marks = F.array(
        F.struct(F.when(announced.startswith("job_"), announced).alias("job_id"), F.lit(True).alias("announced"),
                 F.lit(None).cast("timestamp").alias("a"), F.lit(None).cast("timestamp").alias("b")),
        F.struct(F.when(timed != "", timed).alias("job_id"), F.lit(False).alias("announced"),
                 F.when(starts, ts).alias("a"), F.when(ends, ts).alias("b")))
    events = lines.select("expt_id", F.inline(marks))
    jobs = events.groupBy("expt_id", "job_id").agg(
        F.bool_or("announced").alias("announced"), F.min("a").alias("a"), F.max("b").alias("b"))
    jobs = materialise(jobs.select(
        "expt_id", "job_id", (F.col("announced") & F.col("job_id").isNotNull()).alias("announced"),
        (F.unix_timestamp("b") - F.unix_timestamp("a")).alias("seconds")), "client-jobs")
    idle = jobs.groupBy("expt_id").agg(F.bool_or("announced").alias("any")).filter(~F.col("any"))
    return jobs.filter("announced").select("expt_id", "job_id", "seconds").unionByName(idle.select(
        "expt_id", F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("long").alias("seconds")))


def experiment_stats(settings, jobs, times=None):
    """Settings, job and run time of every run that has settings and an output.

    Without `times` the jobs have their seconds, as client_jobs gives them.
    """
    # The join on both keys comes first: it spreads the jobs of a run, and leaves
    # the join on the run alone last, where skewed partitions can be split.
    timed = jobs if times is None else jobs.join(
        times.select("expt_id", "job_id", "seconds"), ["expt_id", "job_id"], "left")
    # A grid has far more rows than the size of its specification tells the
    # planner, so it must not be picked for a broadcast.
    stats = settings.hint("merge").join(timed, "expt_id")
    row = F.concat_ws(",", "settings", F.coalesce(F.col("seconds").cast("string"), F.lit("")))
    return stats.select("expt_id", "job_id", "settings", "seconds", row.alias("row"))
