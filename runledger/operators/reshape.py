"""Tables made from the results of many runs."""

from pyspark.sql import functions as F

from runledger.operators.ordering import number_rows

# The kinds of artifacts a run leaves behind.
KINDS = ("history", "userlogs", "profiles", "transfers")


def unify(artifacts, runs, kind):
    """Artifacts of one kind of the listed runs, each with its run id and run order.

    A run that is listed more than once counts at its last place.
    """
    if kind not in KINDS:
        raise ValueError(f"the kind must be one of {', '.join(KINDS)}")
    return artifacts.filter(F.col("kind") == kind).join(
        runs.groupBy("expt_id").agg(F.max("run_order").alias("run_order")), "expt_id")


def unify_last_wins(artifacts, name="file_name", order="run_order"):
    """One artifact per file name: the one of the latest run.

    max_by is combined before the shuffle, so a name that very many runs share
    does not gather in one task.
    """
    rest = [c for c in artifacts.columns if c != name]
    latest = artifacts.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return latest.select(name, *[F.col(f"_row.{c}").alias(c) for c in rest])


def unify_lines_last_wins(lines, name="file_name", order="run_order"):
    """All lines of one artifact per file name: the one of the latest run.

    Only names and run orders are gathered; the lines then meet one row per
    name, which is joined by its key, so long artifacts are never one row.
    """
    latest = lines.groupBy(name).agg(F.max(order).alias(order))
    return lines.join(latest, [name, order], "left_semi")


def _same_count(counts):
    if len(set(counts)) > 1:
        raise ValueError(f"the inputs have different numbers of rows: {counts}")


def merge_horizontal(inputs, collapse_copies=True):
    """Put several row sets side by side by position.

    `inputs` is a list of (rows, sort keys). Row counts must agree.
    """
    names = [c for rows, _ in inputs for c in rows.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names must differ between the inputs")
    numbered = [number_rows(rows, keys, collapse_copies=collapse_copies)
                for rows, keys in inputs]
    _same_count([count for _, count in numbered])
    merged = numbered[0][0]
    for rows, _ in numbered[1:]:
        merged = merged.join(rows, "ordinal")
    return merged


def pair_runs(first, second, order="run_order"):
    """Pair the jobs of two experiments by position, under the first one's run id."""
    a = first.select("expt_id", F.col("job_id").alias("job_1"), F.col(order).alias("_a"))
    b = second.select(F.col("job_id").alias("job_2"), F.col(order).alias("_b"))
    return merge_horizontal([(a, ["_a"]), (b, ["_b"])], collapse_copies=False).drop("_a", "_b")


def resolve_profiles(jobs, profiles, shared=None):
    """The profile of every job: the shared one, else by run id, else by job id.

    `profiles` has the columns name and location.
    """
    if shared is not None:
        return jobs.withColumn("profile", F.lit(shared))
    by_run = profiles.select(F.col("name").alias("_run"), F.col("location").alias("_by_run"))
    by_job = profiles.select(F.col("name").alias("_job"), F.col("location").alias("_by_job"))
    found = jobs.join(
        by_run, F.concat(F.lit("profile_job_"), "expt_id", F.lit(".xml")) == F.col("_run"), "left"
    ).join(by_job, F.concat(F.lit("profile_"), "job_id", F.lit(".xml")) == F.col("_job"), "left")
    return found.select(*jobs.columns, F.coalesce("_by_run", "_by_job").alias("profile"))


def jobs_with_conf(jobs, confs):
    """Jobs with the configuration file that carries their id in its name."""
    return jobs.join(confs, "job_id")
