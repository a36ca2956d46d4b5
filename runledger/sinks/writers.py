"""Sinks: table directories, run outputs, design tables, configuration files."""

from pyspark.sql import functions as F

from runledger.functions import delimited
from runledger.functions.text import run_id
from runledger.operators.design import JOB_CONF, PROGRAM
from runledger.session import ship_package, shuffle_partitions, tasks_for
from runledger.sinks.containers import SequenceSource
from runledger.sinks.folders import FolderSource
from runledger.sources.files import opens, qualified

SINGLE_FILE_TABLES = ("region", "nation")
FILES_PER_TASK = 500
# Every task moves its own folders to their place. The driver would move all of them, one after the other.
COMMIT_IN_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
XML_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
SEQUENCE_CODEC = "org.apache.hadoop.io.compress.DefaultCodec"


def _writer(df, compression, mode="errorifexists"):
    writer = df.write.mode(mode)
    return writer.option("compression", compression) if compression else writer


def folder_tasks(rows, keys):
    """Number of tasks that write a folder per key: opening files takes longer than their few bytes tell."""
    folders = rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    return tasks_for(rows.sparkSession, folders, FILES_PER_TASK)


def by_folder(rows, keys, order=(), partitions=None):
    """Rows of a key in one task and in order, the keys dealt to as many tasks as their folders take."""
    return rows.repartition(partitions or folder_tasks(rows, keys), *keys).sortWithinPartitions(*keys, *order)


def _refuse_existing(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise ValueError(f"{path} already exists")


def write_folders(rows, keys, column, directory, suffix=".txt"):
    """A text file per folder of keys and task, for rows as `by_folder` gives them; an existing directory is an error.

    Stores that Arrow does not know are written by Spark, at the price of its files.
    """
    spark = rows.sparkSession
    path = qualified(spark, directory)
    lines = rows.select(*[F.col(key).cast("string").alias(key) for key in keys], column)
    if not opens(path):
        lines.write.options(**COMMIT_IN_TASKS).partitionBy(*keys).text(directory)
        return
    _refuse_existing(spark, path)
    ship_package(spark)
    spark.dataSource.register(FolderSource)
    lines.write.format(FolderSource.name()).mode("append").option("suffix", suffix).save(path)


def write_tables(tables, directory, num_files, fmt="csv", compression=None, placed=False):
    """One directory per table with `num_files` files; existing ones are an error.

    `placed` says that the tables have `num_files` partitions already, as the
    generators make them; then nothing is shuffled.
    """
    for name, df in tables.items():
        if name in SINGLE_FILE_TABLES:
            df = df.coalesce(1)
        elif not placed:
            df = df.repartition(num_files)
        writer = _writer(delimited.escaped(df) if fmt == "csv" else df, compression)
        path = f"{directory.rstrip('/')}/{name}"
        if fmt == "csv":
            writer.options(**delimited.WRITE_OPTIONS).option("sep", "|").csv(path)
        else:
            writer.format(fmt).save(path)


def write_run(df, prefix, expt_id, keep=False, fmt="parquet", compression=None):
    """Output of one run at `<prefix>/<run id>`, in place of what was there.

    A run whose output is not kept is computed in full and discarded.
    """
    if not keep:
        df.write.format("noop").mode("overwrite").save()
        return None
    path = f"{prefix.rstrip('/')}/{expt_id}"
    _writer(df, compression, "overwrite").format(fmt).save(path)
    return path


def keeps_output(delete_on_exit):
    """Only the literal `false` keeps an output."""
    return F.coalesce(delete_on_exit == "false", F.lit(False))


def run_outputs(design):
    """(expt_id, output, keeps): the output folder of every run that names a prefix, and whether it outlives the run.

    Of several prefixes of a run the last one counts; its output stays if any of them says so.
    """
    named = design.filter((F.col("type") == PROGRAM) & (F.col("param") == "jar_output_prefix"))
    return named.groupBy("expt_id").agg(
        F.concat(F.max_by("value", "pos"), F.lit("/"), F.col("expt_id")).alias("output"),
        F.bool_or(keeps_output(F.col("delete_on_exit"))).alias("keeps"))


def design_lines(design):
    """The design table as text, block by block.

    Every file has a header line, one line per run and a blank line. The
    columns differ from file to file, so lines are built as text. One line
    gathers the parameters of one run.
    """
    cells = F.sort_array(F.collect_list(F.struct("pos", "param", F.coalesce(
        "value", F.lit("")).alias("value"))))
    runs = design.groupBy("file_no", "run_no", "file_run").agg(cells.alias("cells"))
    body = runs.select("file_no", F.col("file_run").alias("place"), F.concat_ws(
        "\t", run_id(F.col("run_no")), F.col("cells.value")).alias("line"))
    head = F.concat_ws("\t", F.lit("EXPT_ID"), F.col("cells.param"))
    frame = F.array(F.struct(F.lit(-1).cast("long").alias("place"), head.alias("line")),
                    F.struct(F.lit(2**63 - 1).alias("place"), F.lit("").alias("line")))
    ends = runs.filter(F.col("file_run") == 0).select("file_no", F.explode(frame).alias("f"))
    return body.unionByName(ends.select("file_no", "f.place", "f.line"))


def _ordered_text(rows, keys, column, directory, partitions, compression):
    """Lines in key order over the part files: joined in name order they are one file."""
    n = partitions or shuffle_partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    _writer(ordered.select(column), compression).text(directory)


def write_design(design, directory, partitions=None, compression=None):
    _ordered_text(design_lines(design), ["file_no", "place"], "line", directory, partitions,
                  compression)


def write_run_list(ordered_runs, directory, partitions=None, compression=None):
    """One run id per line, file by file, in run order."""
    _ordered_text(ordered_runs, ["file_no", "place"], "expt_id", directory, partitions,
                  compression)


def _job_settings(design):
    return design.filter(F.col("type") == JOB_CONF).select(
        "expt_id", "pos", F.col("param").alias("name"), "value")


def run_conf_documents(design):
    """The configuration document of every run as a text column."""
    return _documents(_job_settings(design))


def _documents(settings):
    gathered = settings.groupBy("expt_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "name", "value"))).alias("cells"))
    properties = F.transform("cells", lambda c: F.struct(
        c["name"].alias("name"), c["value"].alias("value")))
    return gathered.select("expt_id", F.to_xml(
        F.struct(properties.alias("property")), {"rowTag": "configuration"}).alias("xml"))


def write_run_confs(design, directory, partitions=None, compression=None):
    """A configuration file per run below `expt_id=<run id>`, job settings only.

    For tools that need a file per run. Keep run_conf_documents as a table when
    the runs go into the millions.
    """
    # Rows of a run must meet in one task: a document is one file.
    settings = _job_settings(design)
    if not compression:
        dealt = settings.repartition(partitions or folder_tasks(settings, ["expt_id"]), "expt_id")
        documents = _documents(dealt).sortWithinPartitions("expt_id")
        write_folders(documents.withColumn("xml", F.concat(F.lit(XML_HEAD), "xml")), ["expt_id"], "xml", directory, ".xml")
        return
    rows = by_folder(settings, ["expt_id"], ["pos"], partitions)
    _writer(rows.drop("pos"), compression).options(**COMMIT_IN_TASKS).partitionBy("expt_id").format("xml").option(
        "rootTag", "configuration").option("rowTag", "property").save(directory)


def pack_artifacts(artifacts, path, partitions=None, compression="zstd"):
    """Lines of the artifacts of many runs in few files per kind: (expt_id, kind, file_name, line_no, line).

    Rows are cut in even ranges of (kind, run, file, line) and sorted, so a run's
    lines are neighbours, a huge run is shared by tasks, and the row groups' own
    statistics are the table of offsets: a reader of few runs skips all others.
    """
    keys = ["kind", "expt_id", "file_name", "line_no"]
    n = partitions or shuffle_partitions(artifacts.sparkSession)
    ordered = artifacts.select(*keys, "line").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    _writer(ordered, compression).partitionBy("kind").parquet(path)


def write_manifest(job_map, path, compression=None):
    """Run to job table; a run without a job is written as `Null`."""
    rows = job_map.select(
        F.col("expt_id").alias("EXPT_ID"),
        F.coalesce("job_id", F.lit("Null")).alias("HADOOP_JOB_ID"))
    _writer(rows, compression).option("sep", "\t").option("header", "true").csv(path)


def write_tsv(df, path, compression=None):
    """Tab-separated rows; `read_delimited` gives back the same values."""
    _writer(delimited.escaped(df), compression).options(**delimited.WRITE_OPTIONS).option("sep", "\t").csv(path)


def write_sequence(df, key, value, path, codec=SEQUENCE_CODEC):
    """Block-compressed key/value files, for readers that need that container.

    Files appear when the whole job has ended. A path that is there is an error, as is
    a null. Prefer compressed parquet for everything that Spark reads back.
    """
    if codec != SEQUENCE_CODEC:
        raise ValueError(f"containers are written with {SEQUENCE_CODEC}")
    spark = df.sparkSession
    _refuse_existing(spark, path)
    ship_package(spark)
    spark.dataSource.register(SequenceSource)
    df.select(key, value).write.format(SequenceSource.name()).mode("append").option("codec", codec).save(path)


def read_sequence(spark, path, schema):
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)
