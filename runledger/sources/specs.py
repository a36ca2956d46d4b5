"""Parameter specifications, run manifests and per-job configuration files."""

from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.text import strip
from runledger.operators.ordering import with_ordinal
from runledger.session import shared_listing
from runledger.sources.files import read_small_files
from runledger.sources.lines import RUN_PATTERN, read_lines

JOB_IN_NAME = r"_(job_[0-9]+_[0-9]+)_conf\.xml$"
# The name of a configuration file, or of a folder that holds its part file.
CONF_IN_PATH = r"([^/=]+_conf\.xml)(?:/[^/]+)?$"


def parse_param_specs(documents, file_no="file_no", file="file", xml="xml"):
    """One row per property of every document, in document order.

    `documents` has one row per specification with its number, name and text.
    """
    schema = schemas.SPEC_DOCUMENT.simpleString()
    parsed = documents.select(
        F.col(file_no).cast("long").alias("file_no"), F.col(file).alias("file"),
        F.from_xml(F.col(xml), schema, {"ignoreSurroundingSpaces": "false"}).alias("doc"))
    rows = parsed.select("file_no", "file", F.posexplode("doc.property").alias("pos", "p"))
    return rows.select(
        "file_no", "file", F.col("pos").cast("long").alias("pos"),
        F.col("p.name").alias("name"), F.col("p.type").alias("type"),
        F.col("p.numvalues").alias("numvalues"),
        F.col("p.value_delimitter").alias("value_delimitter"),
        F.col("p.values").alias("values"), F.col("p.delete_on_exit").alias("delete_on_exit"))


def read_param_specs(spark, path):
    """A specification file, or every `*.xml` of a directory in name order."""
    reader = spark.read.option("pathGlobFilter", "*.xml")
    with shared_listing(spark):
        texts = reader.text(path, wholetext=True)
    documents = texts.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml")
    ).filter(F.trim("xml") != "")
    numbered = with_ordinal(documents, ["file"], name="file_no", start=0, collapse_copies=False)
    return parse_param_specs(numbered)


def read_manifest(spark, path):
    """Run to job table: header line, tab between the columns, `Null` for no job."""
    rows = (spark.read.schema(schemas.MANIFEST).option("sep", "\t").option("header", "true")
            .option("enforceSchema", "true").csv(path))
    job = strip(F.col("job_id"))
    return rows.select(
        strip(F.col("expt_id")).alias("expt_id"),
        F.when(job.startswith("job_"), job).alias("job_id"))


def read_run_list(spark, path):
    """One run id per non-blank line, in run order."""
    lines = read_lines(spark, path)
    return lines.select(F.col("line_no").alias("run_order"), strip(F.col("line")).alias("expt_id")
                        ).filter(F.col("expt_id") != "")


def conf_properties(documents, xml="xml"):
    """Name and value of every property of configuration documents in a text column."""
    kept = [c for c in documents.columns if c != xml]
    parsed = documents.select(*kept, F.from_xml(
        xml, schemas.CONF_DOCUMENT.simpleString(), {"ignoreSurroundingSpaces": "false"}
    ).alias("doc"))
    return parsed.select(*kept, F.explode("doc.property").alias("p")).select(
        *kept, "p.name", "p.value")


def _read_confs(spark, path):
    """Name and value of every property, file by file.

    A configuration file is a small document, read as one text value: a task reads many
    files, which the XML source does not do.
    """
    texts = read_small_files(spark, path, F.lit(0).cast("long"), whole=True)
    return conf_properties(texts.select(
        "path", F.regexp_extract("path", CONF_IN_PATH, 1).alias("conf"), F.col("value").alias("xml")))


def read_job_confs(spark, path):
    """Properties of every `*_<job>_conf.xml`, keyed by the job id in the name."""
    rows = with_job_of_conf(_read_confs(spark, f"{path.rstrip('/')}/*_conf.xml"))
    return rows.filter(F.col("job_id").isNotNull()).drop("path")


def read_run_confs(spark, directory):
    """Properties of the configuration documents below `expt_id=<run id>`."""
    rows = _read_confs(spark, f"{directory.rstrip('/')}/*")
    return rows.select(F.regexp_extract("path", RUN_PATTERN, 1).alias("expt_id"), "name", "value")


def with_job_of_conf(confs, name="conf"):
    job = F.regexp_extract(F.col(name), JOB_IN_NAME, 1)
    return confs.withColumn("job_id", F.when(job != "", job))
