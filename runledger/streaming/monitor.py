"""Monitor captures as a stream of files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.operators import monitor
from runledger.session import scratch_path
from runledger.sources.lines import CAPTURE_PATTERN, MONITOR_FILES, cpu_reports

_PARSERS = {"disk": monitor.disk_samples, "memory": monitor.memory_samples}


def stream_samples(spark, directory, kind, files_per_trigger=None):
    """Typed samples of timed captures as the files arrive.

    A stream has no next line, so CPU captures are cut at their headers.
    """
    if kind not in MONITOR_FILES:
        raise ValueError(f"unknown monitor kind {kind!r}")
    reader = spark.readStream.format("text").schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if kind == "cpu":
        return monitor.cpu_report_samples(cpu_reports(reader, directory), timed=True)
    lines = reader.load(f"{directory.rstrip('/')}/{MONITOR_FILES[kind]}").select(
        F.regexp_extract(F.col("_metadata.file_path"), CAPTURE_PATTERN, 1).alias("host"),
        F.col("value").alias("line"))
    return _PARSERS[kind](lines, timed=True)


def once(samples, lateness="2 minutes"):
    """Every sample once, also when its capture is delivered again.

    A sample is its host, second and values. Those that are not yet late are kept
    as state, so a copy is known; a copy that comes later is behind the watermark and
    dropped as any late row is. Either way it does not count twice. The watermark starts
    at second 0 of the epoch, so a sample of that very second counts as late.
    """
    return samples.withWatermark("ts", lateness).dropDuplicates(samples.columns)


def drain_once(samples, path, state, lateness="2 minutes"):
    """Take in the files that are there, add each new sample to the table at `path`, give the table as a stream.

    A stage of its own, as windows that are written while open cannot follow
    another state in one stream. Later calls take the same path and state.
    """
    drain_samples(once(samples, lateness), path, state)
    return samples.sparkSession.readStream.schema(samples.schema).parquet(path)


def stream_utilisation(samples, metrics, window="1 minute", lateness="2 minutes", sketched=False):
    """Mean and peak per host and tumbling window; rows later than allowed are dropped.

    With `sketched` every window also has the quantile sketches of its metrics.
    """
    measures = [F.count(F.lit(1)).alias("samples")]
    for name in metrics:
        measures += [F.avg(name).alias(f"avg_{name}"), F.max(name).alias(f"max_{name}")]
    drawn = monitor.sketches(metrics) if sketched else []
    return samples.withWatermark("ts", lateness).groupBy(
        F.window("ts", window).alias("window"), "host").agg(*measures, *drawn).select(
        F.col("window.start").alias("window_start"), "host",
        *["samples", *[f"{how}_{name}" for name in metrics for how in ("avg", "max")]],
        *[f"sketch_{name}" for name in metrics if sketched])


def drain_samples(samples, path=None, state=None):
    """Take in all files that are there, append the rows to parquet, read them back."""
    spark = samples.sparkSession
    path = path or scratch_path(spark, "stream-out")
    samples.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", state or scratch_path(spark, "stream-state")
    ).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(samples.schema).parquet(path)


def drain_utilisation(utilisation, path=None, state=None):
    """All windows, open ones too, after taking in the files that are there.

    Every batch writes the windows it changed to a folder of its own, so a batch
    that is run again does no harm, and the last batch of a window has its final
    values. Rows of windows that the watermark has closed are dropped, and only
    open windows are kept as state. A later call with the same path and state
    takes in the files that came since.
    """
    spark = utilisation.sparkSession
    path = path or scratch_path(spark, "stream-out")
    state = state or scratch_path(spark, "stream-state")

    # A stream that has no files yet runs no batch; its result is this empty one.
    spark.createDataFrame([], utilisation.schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def changed(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    utilisation.writeStream.outputMode("update").foreachBatch(changed).option(
        "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    schema = utilisation.schema
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    keys = ["window_start", "host"]
    rest = [c for c in utilisation.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
