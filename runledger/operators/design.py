"""Experiment grids: checked parameter lists, numbered runs, run order."""

from pyspark.sql import functions as F

from runledger.functions.sampling import permuted
from runledger.functions.text import run_id, split_list
from runledger.operators.ordering import running_total
from runledger.session import materialise, shuffle_partitions

# The two parameter types, the names a program parameter may
# have, and the defaults.
JOB_CONF = "MAPREDUCE_JOBCONF"
PROGRAM = "HADOOP_JAR"
PROGRAM_NAMES = ["jar_path", "jar_class_name", "jar_input_params", "jar_output_prefix"]
DEFAULT_DELIMITER = ","

RUNS_PER_BLOCK = 1 << 14


def split_values(specs):
    """Add the effective type and the value list of every property.

    A lone `|` separates literally; any other delimiter is a regular expression.
    """
    given = F.col("value_delimitter")
    delimiter = (F.when(F.coalesce(given, F.lit("")) == "", DEFAULT_DELIMITER)
                 .when(given == "|", r"\|").otherwise(given))
    return specs.withColumn("type", F.coalesce(F.col("type"), F.lit(JOB_CONF))).withColumn(
        "value_list", split_list(F.col("values"), delimiter))


def _judged(specs):
    """Properties with value lists and what is wrong with them, NULL if nothing is."""
    declared = F.trim("numvalues").try_cast("int")
    return split_values(specs).withColumn("declared", declared).withColumn(
        "violation",
        F.when(declared.isNull() | (declared <= 0), "numvalues must be above 0")
        .when(F.size("value_list") != declared, "numvalues does not match the values")
        .when(~F.col("type").isin(JOB_CONF, PROGRAM), "unsupported type")
        .when((F.col("type") == PROGRAM) & ~F.col("name").isin(PROGRAM_NAMES),
              "unsupported program parameter"))


def _parted(judged):
    accepted = judged.filter(F.col("violation").isNull()).drop("violation", "declared")
    violations = judged.filter(F.col("violation").isNotNull()).select(
        "file_no", "file", "pos", "name", "type", "numvalues", "values", "violation")
    return accepted, violations


def validate_specs(specs):
    """(accepted properties with value lists, violations with their reason)."""
    return _parted(_judged(specs))


def checked_specs(specs):
    """Accepted properties; raises when any property is not acceptable.

    They are written once, so documents are parsed once and not again behind the check.
    """
    accepted, violations = _parted(materialise(_judged(specs), "specs"))
    first = violations.take(5)
    if first:
        raise ValueError("; ".join(f"{r['file']}: {r['name']}: {r['violation']}" for r in first))
    return accepted


def _product(counts):
    """Product of the value counts of one file, a list as long as its properties."""
    return F.aggregate(counts, F.lit(1).cast("long"), lambda a, b: a * b)


def design_size(specs):
    """Runs per file: the product of the value counts, exact or an overflow error."""
    counts = F.collect_list(F.size("value_list").cast("long"))
    return specs.groupBy("file_no").agg(_product(counts).alias("runs"), F.count(F.lit(1)).alias("params"))


def design_total(specs):
    return design_size(specs).agg(F.sum("runs").alias("runs"))


def _numbered_runs(files):
    """Every row once per run of its file, `_i` counting from 0, in even blocks of runs."""
    last_block = F.call_function("div", F.col("_runs") - 1, F.lit(RUNS_PER_BLOCK))
    blocks = files.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    # An explicit number: block rows are small and would be coalesced to one task.
    blocks = blocks.repartition(shuffle_partitions(files.sparkSession), "file_no", "_block")
    low = F.col("_block") * RUNS_PER_BLOCK
    high = F.least(low + RUNS_PER_BLOCK, F.col("_runs")) - 1
    return blocks.withColumn("_i", F.explode(F.sequence(low, high)))


def design_runs(specs):
    """The runs of the grid of all files without their parameters, as design_ids gives them from the grid.

    The sizes of the files say all there is to know, so parameters are not written out and nothing
    is made distinct.
    """
    sizes = design_size(specs).select("file_no", F.col("runs").alias("_runs"))
    files = running_total(sizes, ["file_no"], "_runs", "_first").filter(F.col("_runs") > 0)
    run_no = F.col("_first") + F.col("_i")
    return _numbered_runs(files).select(
        run_id(run_no).alias("expt_id"), run_no.alias("run_no"), "file_no", F.col("_i").alias("file_run"), F.col("_runs").alias("file_runs"))


def expand_design(specs):
    """The cross product of the value lists, one row per run and parameter.

    Run i of a file takes value (i div inner) mod n of a parameter with n
    values, where inner is the product of the value counts after it: the last
    parameter varies fastest. So every parameter row can write its column of
    the grid on its own, without a join of the lists. Rows are cut in blocks of
    runs first, so that one huge file is expanded by many tasks. Run numbers
    continue from file to file.

    The properties of a file are gathered in one row, written once with the
    number of its first run, and unfolded again.
    """
    props = F.sort_array(F.collect_list(F.struct("pos", "name", "type", "value_list", "delete_on_exit")))
    files = specs.groupBy("file_no").agg(props.alias("_props"))
    counts = F.transform("_props", lambda p: F.size(p["value_list"]).cast("long"))
    files = files.withColumn("_counts", counts).withColumn("_runs", _product(F.col("_counts")))
    files = running_total(files, ["file_no"], "_runs", "_first").filter(F.col("_runs") > 0)
    rows = files.select("file_no", "_first", "_runs", "_counts", F.posexplode("_props").alias("_at", "_p"))
    inner = _product(F.slice("_counts", F.col("_at") + 2, F.size("_counts")))
    sized = rows.select("file_no", "_first", "_runs", "_p.*", inner.alias("_inner"), F.get("_counts", "_at").alias("_n"))
    runs = _numbered_runs(sized)
    index = (F.call_function("div", F.col("_i"), F.col("_inner")) % F.col("_n")).cast("int")
    run_no = F.col("_first") + F.col("_i")
    return runs.select(
        run_id(run_no).alias("expt_id"), run_no.alias("run_no"), "file_no",
        F.col("_i").alias("file_run"), F.col("_runs").alias("file_runs"), "pos", F.col("name").alias("param"), "type", F.get("value_list", index).alias("value"),
        "delete_on_exit")


def design_ids(design):
    """One row per run, whatever the places of its parameters; combined before the shuffle."""
    return design.select("expt_id", "run_no", "file_no", "file_run", "file_runs").distinct()


def run_order(runs, seed=None):
    """Place of every run in its file, 0-based: by number, or a seeded permutation.

    The permutation is a bijection of the runs of a file that is computed from the run's
    number in its file alone, so a run's place needs no shuffle and no window.
    """
    if seed is None:
        return runs.withColumn("place", F.col("file_run"))
    return runs.withColumn("place", permuted(F.col("file_run"), F.col("file_runs"), F.lit(seed), F.col("file_no")))


def union_designs(first, *others):
    """Append designs whose parameters differ; run numbers must not overlap."""
    design = first
    for other in others:
        design = design.unionByName(other)
    return design


def wide_design(design):
    """One row per run with a map from parameter to value.

    The size of a map is the number of properties of one specification file.
    """
    return design.groupBy("expt_id", "run_no", "file_no").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", "value")))
                           ).alias("params"))


def stats_row(design):
    """Settings of every run in file order, each cut to its first word.

    Only job settings are part of a run's configuration file.
    """
    word = F.coalesce(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)), F.lit(""))
    settings = design.filter(F.col("type") == JOB_CONF).select(
        "expt_id", "run_no", F.struct("pos", word.alias("word")).alias("setting"))
    return settings.groupBy("expt_id").agg(
        F.first("run_no").alias("run_no"),
        F.sort_array(F.collect_list("setting")).alias("settings")
    ).select("expt_id", "run_no", F.col("settings.word").alias("settings"))
