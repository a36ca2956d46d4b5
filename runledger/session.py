"""Session set-up, the shared scratch folder and the size check for broadcasts."""

import math
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT = 64 * 1024 * 1024
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus=8, memory="8g", **extra):
    """A local session for tests and the bench; on a cluster bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("runledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true"))
    if CHECKPOINT_KEY not in extra:
        builder = builder.config(CHECKPOINT_KEY, tempfile.mkdtemp(prefix="runledger-"))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED = set()


def ship_package(spark):
    """Let Python workers import this package wherever they start; once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="runledger-"), "runledger")
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, "runledger"))
        _SHIPPED.add(application)


def is_local(master):
    """Whether driver and executors are one process and share every folder."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark, label):
    """A fresh path in the shared folder that the cluster names.

    Tables written there survive the loss of any executor. Only a local master
    may fall back to a folder of its own machine.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not is_local(spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"runledger-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/runledger/{label}-{uuid.uuid4().hex}"


def materialise(df, label):
    """Cut the lineage: write the rows to the shared folder and read them back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df, column, label):
    """Like materialise, the rows hashed into one bucket per shuffle partition and sorted there.

    Merge joins of such tables on the column, with each other or with rows shuffled
    on it, leave them where they are; a filter on a few values of it reads their buckets only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = os.path.basename(path).replace("-", "_")
    n = shuffle_partitions(spark)
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(name)
    table = spark.table(name)
    # The name is only needed to write buckets; the files stay, and the table reads them.
    spark.sql(f"DROP TABLE {name}")
    return table


def _width(field):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 32
    return F.lit(16)


def row_size(df):
    """(number of rows, their total size in memory), measured in one distributed pass."""
    width = F.lit(8).cast("long")
    for field in df.schema.fields:
        width = width + _width(field)
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first())


def row_bytes(df):
    """Total size of the rows in memory."""
    return row_size(df)[1]


def fits_broadcast(df, limit=BROADCAST_LIMIT):
    return row_bytes(df) <= limit


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark, amount, per_task):
    """Shuffle partitions of at most about `per_task` each, and never fewer than the session's."""
    return max(shuffle_partitions(spark), math.ceil(amount / per_task))


_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30}


def conf_bytes(spark, key):
    """A setting that is a size."""
    text = spark.conf.get(key).strip().lower()
    digits = text.rstrip("bkmg")
    return int(digits) * _UNITS[text[len(digits):] or "b"]


LISTING_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS_PER_CORE = 4


@contextmanager
def shared_listing(spark):
    """Many folders are listed by a few tasks a core. Spark would start a task per folder, up to 10,000.

    Folders are listed while a batch reader loads, so only that needs to be inside.
    """
    before = spark.conf.get(LISTING_KEY, None)
    spark.conf.set(LISTING_KEY, str(LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(LISTING_KEY) if before is None else spark.conf.set(LISTING_KEY, before)
