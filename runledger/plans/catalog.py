"""Every operator as a query over the given tables."""

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.delimited import read_delimited
from runledger.functions.sampling import zipf_rank
from runledger.functions.text import run_id
from runledger.operators import (
    attempts, clientlogs, corpus, design, jobs, joins, monitor, ordering, reshape)
from runledger.plans import domains, render
from runledger.session import materialise, scratch_path, shared_listing, shuffle_partitions
from runledger.sinks import writers
from runledger.sources import generate
from runledger.sources.lines import (
    read_artifacts, read_attempt_logs, read_client_logs, read_cpu_reports, read_monitor, read_packed, read_text)
from runledger.sources.specs import (
    conf_properties, parse_param_specs, read_job_confs, read_manifest, read_param_specs, read_run_confs, read_run_list,
    with_job_of_conf)
from runledger.sources.tables import read_table, read_tpch, spread
from runledger.sources.wiki import read_wiki_xml
from runledger.streaming import monitor as stream

RECORDS_PER_TASK = 10_000_000
TEXT_BYTES_PER_TASK = 500 * 1024 * 1024


def _events(spark, sf):
    return spread(read_table(spark, sf, "events"))


# ---- attempt logs -----------------------------------------------------------

def attempt_lines(spark, sf, **options):
    return render.attempt_lines(_events(spark, sf), **options)


def attempt_times(spark, sf):
    return attempts.attempt_times(attempt_lines(spark, sf))


def attempt_log_files(spark, sf):
    """Write every attempt's log to its folder, scan the tree, time the attempts."""
    path = scratch_path(spark, "attempt-logs")
    attempt = ["host", "attempt_id"]
    writers.write_folders(writers.by_folder(attempt_lines(spark, sf), attempt, ["line_no"]), attempt, "line", path)
    return attempts.attempt_times(read_attempt_logs(spark, f"{path}/*/*"))


def map_attempt_times(spark, sf):
    return attempts.map_attempt_times(attempt_lines(spark, sf))


def reduce_attempt_times(spark, sf):
    return attempts.reduce_attempt_times(attempt_lines(spark, sf))


def attempt_report(spark, sf):
    times = attempts.map_attempt_times(attempt_lines(spark, sf))
    return times.select("host", attempts.report_line().alias("line"))


def attempt_rejects(spark, sf):
    lines = attempt_lines(spark, sf)
    broken = F.when(F.col("line_no") % 31 == 0, "no time here").otherwise(F.col("line"))
    return attempts.attempt_rejects(lines.withColumn("line", broken))


def attempts_of(spark, sf):
    lines = attempts.attempts_of(attempt_lines(spark, sf), "job_202401010000_0004", "m")
    return attempts.with_attempt_parts(lines).select(
        "host", "attempt_id", "job_id", "phase", "task", "try_no", "line_no")


def spill_gaps(spark, sf):
    return attempts.spill_gaps(attempt_lines(spark, sf, ranked_spills=True))


def job_summary(spark, sf):
    summary = attempts.job_summary(attempt_times(spark, sf))
    return _comparable(summary)


def logs_for_runs(spark, sf):
    """Attempt lines of the jobs that the client logs name."""
    return attempts.logs_for_runs(attempt_lines(spark, sf), job_ids(spark, sf)).select(
        "host", "attempt_id", "line_no")


def shuffle_transfers(spark, sf):
    lines = render.transfer_lines(_events(spark, sf))
    return attempts.shuffle_transfers(lines).select("host", "attempt_id", "line_no")


def latest_attempts(spark, sf):
    files = render.attempt_files(_events(spark, sf))
    newest = attempts.latest_attempts(files)
    return ordering.with_ordinal(newest, [F.desc("modified"), "host", "attempt_id"],
                                 name="position", collapse_copies=False)


# ---- client logs ------------------------------------------------------------

def client_lines(spark, sf):
    return render.client_lines(_events(spark, sf))


def job_ids(spark, sf):
    return clientlogs.extract_job_ids(client_lines(spark, sf))


def run_job_map(spark, sf):
    runs = render.runs_of(_events(spark, sf))
    return clientlogs.run_job_map(runs, job_ids(spark, sf))


def job_run_times(spark, sf):
    return clientlogs.job_run_times(client_lines(spark, sf)).select("expt_id", "job_id", "seconds")


def client_log_files(spark, sf):
    """Write the client output of every run to its folder, scan it back, time the jobs."""
    lines = render.client_lines(_events(spark, sf))
    path = scratch_path(spark, "client-logs")
    ordered = lines.repartitionByRange(writers.folder_tasks(lines, ["expt_id"]), "expt_id", "line_no").sortWithinPartitions(
        "expt_id", "line_no")
    ordered.select("expt_id", "line").write.options(**writers.COMMIT_IN_TASKS).partitionBy("expt_id").text(path)
    return clientlogs.job_run_times(read_client_logs(spark, f"{path}/*")).select(
        "expt_id", "job_id", "seconds")


def manifest_roundtrip(spark, sf):
    path = scratch_path(spark, "manifest")
    writers.write_manifest(run_job_map(spark, sf), path)
    return read_manifest(spark, path)


def experiment_stats(spark, sf):
    """Runs that have both settings and client output, with their jobs and run times."""
    stats = clientlogs.experiment_stats(
        design.stats_row(grid(spark, sf, "supplier", "s_suppkey")), clientlogs.client_jobs(client_lines(spark, sf)))
    return stats.select("expt_id", "job_id", "seconds", "row")


def sort_stats(spark, sf):
    settings = design.stats_row(grid(spark, sf, "supplier", "s_suppkey"))
    columns = settings.select(
        "expt_id", "run_no", *[F.get("settings", F.lit(i)).alias(f"p{i}") for i in range(3)])
    return ordering.sort_stats(columns, ["p0", "p1", "run_no"], name="position", collapse_copies=False)


# ---- designs ----------------------------------------------------------------

def specs(spark, sf, table="customer", key="c_custkey"):
    return parse_param_specs(render.spec_documents(spread(read_table(spark, sf, table).select(key)), key))


def grid(spark, sf, table="customer", key="c_custkey"):
    """The grid of all files; a file that is not acceptable stops the query."""
    return design.expand_design(design.checked_specs(specs(spark, sf, table, key)))


def runs_of_grid(spark, sf, table="customer", key="c_custkey"):
    return design.design_runs(design.checked_specs(specs(spark, sf, table, key)))


def design_expand(spark, sf):
    return grid(spark, sf).select("expt_id", "run_no", "file_no", "pos", "param", "type", "value")


def design_ids(spark, sf):
    return design.design_ids(grid(spark, sf)).select("expt_id", "run_no", "file_no")


def design_size(spark, sf):
    return design.design_size(design.checked_specs(specs(spark, sf)))


def design_total(spark, sf):
    return design.design_total(design.checked_specs(specs(spark, sf)))


def spec_values(spark, sf):
    rows = design.split_values(specs(spark, sf))
    return rows.select("file_no", "pos", "name", "type",
                       F.posexplode("value_list").alias("value_no", "value"))


def spec_files(spark, sf):
    """Write a specification file per supplier, read the folder in name order, list the values."""
    path = scratch_path(spark, "specs")
    named = specs(spark, sf, "supplier", "s_suppkey").withColumn("file", F.format_string("spec-%012d", "file_no"))
    writers.by_folder(named, ["file"], ["pos"]).select(
        "file", "name", "type", "numvalues", "value_delimitter", "values", "delete_on_exit",
    ).write.options(**writers.COMMIT_IN_TASKS).partitionBy("file").format("xml").option("rootTag", "configuration").option(
        "rowTag", "property").save(path)
    rows = design.split_values(read_param_specs(spark, f"{path}/*"))
    return rows.select("file_no", F.regexp_extract("file", "spec-([0-9]+)", 1).cast("long").alias("source"), "pos",
                       "name", "type", F.posexplode("value_list").alias("value_no", "value"))


def spec_violations(spark, sf):
    rows = specs(spark, sf)
    broken = rows.withColumn(
        "numvalues", F.when((F.col("file_no") % 7 == 0) & (F.col("pos") == 2), "9")
        .when((F.col("file_no") % 11 == 0) & (F.col("pos") == 3), "0")
        .otherwise(F.col("numvalues"))).withColumn(
        "type", F.when((F.col("file_no") % 13 == 0) & (F.col("pos") == 4), "OTHER")
        .otherwise(F.col("type"))).withColumn(
        "name", F.when((F.col("file_no") % 17 == 0) & (F.col("pos") == 0), "jar_owner")
        .otherwise(F.col("name")))
    return design.validate_specs(broken)[1].select("file_no", "pos", "violation")


def run_order(spark, sf):
    return design.run_order(runs_of_grid(spark, sf)).select("expt_id", "file_no", "place")


def run_order_shuffled(spark, sf):
    """Every run with its place in the seeded permutation of its file."""
    return design.run_order(runs_of_grid(spark, sf), seed=42).select("expt_id", "file_no", "place")


def run_list_file(spark, sf):
    """The run list beside the design table: one file in shuffled order, file by file, read back and numbered."""
    path = scratch_path(spark, "run-list")
    ordered = design.run_order(runs_of_grid(spark, sf, "supplier", "s_suppkey"), seed=42)
    writers.write_run_list(ordered, path, 1)
    return ordering.with_ordinal(read_run_list(spark, f"{path}/part-*"), ["run_order"], name="position").select("position", "expt_id")


def union_designs(spark, sf):
    small = grid(spark, sf, "supplier", "s_suppkey")
    other = grid(spark, sf, "nation", "n_nationkey").withColumn(
        "run_no", F.col("run_no") + 1_000_000_000).withColumn("expt_id", run_id(F.col("run_no"))
        ).filter(F.col("param") != "io.sort.mb")
    wide = design.wide_design(design.union_designs(small, other))
    return wide.select("expt_id", F.size("params").alias("n_params"),
                       F.col("params")["mapred.reduce.tasks"].alias("tasks"),
                       F.try_element_at("params", F.lit("io.sort.mb")).alias("sort_mb"))


def design_tsv(spark, sf):
    path = scratch_path(spark, "design")
    writers.write_design(grid(spark, sf, "supplier", "s_suppkey"), path)
    return spark.read.schema("line string").text(path)


def run_conf_documents(spark, sf):
    documents = writers.run_conf_documents(grid(spark, sf))
    return conf_properties(documents).select("expt_id", "name", "value")


def run_confs_roundtrip(spark, sf):
    path = scratch_path(spark, "confs")
    writers.write_run_confs(grid(spark, sf, "supplier", "s_suppkey"), path)
    return read_run_confs(spark, path).select("expt_id", "name", "value")


# ---- benchmark jobs ---------------------------------------------------------

def total_sort(spark, sf):
    rows = read_table(spark, sf, "lineitem")
    return ordering.with_ordinal(rows, rows.columns, name="position", from_files=True)


def word_count(spark, sf):
    return jobs.word_count(spread(read_table(spark, sf, "documents").select("text")), "text")


def text_corpus(spark, sf):
    """Words of the documents as a text corpus in files."""
    path = scratch_path(spark, "text")
    spread(read_table(spark, sf, "documents").select("text").filter("text is not null")).write.text(path)
    return jobs.word_count(read_text(spark, path), "line")


def _part_lineitem(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return part, line


def join_merge(spark, sf):
    part, line = _part_lineitem(spark, sf)
    return jobs.JOBS["DefaultJoin"](part, 1, line, 2)


def join_reducers(spark, sf):
    """The merge join with a fixed number of reducers."""
    part, line = _part_lineitem(spark, sf)
    return joins.join_by_position(part, 1, line, 2, n=6)


def join_broadcast(spark, sf):
    part, line = _part_lineitem(spark, sf)
    return jobs.JOBS["MapJoin"](part, 1, line, 2)


def join_salted(spark, sf):
    part, line = _part_lineitem(spark, sf)
    return joins.join_by_position(part, 1, line, 2, strategy="salted")


def join_partsupp(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    pairs = read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    return joins.join_by_position(part, 1, pairs, 2)


# ---- reshaping --------------------------------------------------------------

def merge_horizontal(spark, sf):
    rows = read_table(spark, sf, "orders")
    left = rows.select("o_orderkey", "o_orderdate")
    right = rows.select(F.col("o_orderkey").alias("by_price_key"), "o_totalprice")
    return reshape.merge_horizontal(
        [(left, ["o_orderkey"]), (right, ["o_totalprice", "by_price_key"])],
        collapse_copies=False)


def pair_runs(spark, sf):
    rows = read_table(spark, sf, "orders")
    first = rows.select(run_id(F.col("o_orderkey")).alias("expt_id"),
                        render.job_name(F.col("o_orderkey")).alias("job_id"),
                        F.col("o_orderkey").alias("run_order"))
    second = rows.select(render.job_name(F.col("o_orderkey") + 1_000_000).alias("job_id"),
                         F.struct("o_totalprice", "o_orderkey").alias("run_order"))
    return reshape.pair_runs(first, second)


def resolve_profiles(spark, sf):
    line = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("expt_id"),
        F.col("l_partkey").cast("string").alias("job_id"))
    by_run = read_table(spark, sf, "supplier").select(
        F.concat(F.lit("profile_job_"), "s_suppkey", F.lit(".xml")).alias("name"),
        F.col("s_name").alias("location"))
    by_job = read_table(spark, sf, "part").select(
        F.concat(F.lit("profile_"), F.col("p_partkey") * 2, F.lit(".xml")).alias("name"),
        F.col("p_name").alias("location"))
    return reshape.resolve_profiles(line, by_run.union(by_job))


def shared_profile(spark, sf):
    """One profile for the jobs of all runs."""
    jobs_of = read_table(spark, sf, "orders").select(
        run_id(F.col("o_orderkey")).alias("expt_id"), render.job_name(F.col("o_custkey")).alias("job_id"))
    return reshape.resolve_profiles(jobs_of, None, shared="/profiles/all.xml")


def unify(spark, sf):
    events = _events(spark, sf)
    return reshape.unify(render.artifacts(events), render.started_runs(events), "userlogs")


def unify_last_wins(spark, sf):
    return reshape.unify_last_wins(unify(spark, sf)).select("file_name", "expt_id", "content")


def unify_files(spark, sf):
    """Artifacts written to a folder per run and kind, read back for a run list that names some runs twice."""
    events = _events(spark, sf)
    path, listed = scratch_path(spark, "artifacts"), scratch_path(spark, "run-list")
    number = F.regexp_extract("expt_id", r"(\d+)", 1).cast("long")
    files = render.artifacts(events).groupBy("expt_id", "kind").agg(F.max("content").cast("string").alias("content"))
    files = files.withColumn("file_name", F.concat_ws("_", "kind", number % 7))
    folder = ["expt_id", "kind", "file_name"]
    writers.write_folders(writers.by_folder(files, folder), folder, "content", path)
    runs = render.started_runs(events)
    again = runs.filter(F.col("run_order") % 3 == 0)
    both = runs.withColumn("turn", F.lit(1)).unionByName(again.withColumn("turn", F.lit(2)))
    # A run list is one file, as its order is that of its lines.
    both.repartitionByRange(1, "turn", "run_order").sortWithinPartitions("turn", "run_order").select("expt_id").write.text(listed)
    artifacts = read_artifacts(spark, path, "userlogs").withColumnRenamed("line", "content")
    unified = reshape.unify(artifacts.drop("line_no"), read_run_list(spark, f"{listed}/part-*"), "userlogs")
    return reshape.unify_last_wins(unified).select("file_name", "expt_id", F.col("content").cast("double"))


def unify_packed(spark, sf):
    """Artifacts of two lines each in packed files, read back by kind, the latest run's file of each name."""
    events = _events(spark, sf)
    path = scratch_path(spark, "packed")
    both = F.array(F.col("content").cast("string"), F.concat_ws("/", "expt_id", "file_name"))
    lines = render.artifacts(events).select("expt_id", "kind", "file_name", F.posexplode(both).alias("line_no", "line"))
    writers.pack_artifacts(lines.withColumn("line_no", F.col("line_no").cast("long")), path)
    unified = reshape.unify(read_packed(spark, path, "userlogs"), render.started_runs(events), "userlogs")
    return reshape.unify_lines_last_wins(unified).select("file_name", "expt_id", "line_no", F.when(
        F.col("line_no") == 0, F.col("line").cast("double")).alias("content"), F.when(F.col("line_no") == 1, F.col("line")).alias("origin"))


def jobs_with_conf(spark, sf):
    started = read_table(spark, sf, "orders").select(
        run_id(F.col("o_orderkey")).alias("expt_id"),
        render.job_name(F.col("o_custkey")).alias("job_id"))
    confs = read_table(spark, sf, "customer").select(
        F.concat(F.lit("localhost_1_"), render.job_name(F.col("c_custkey")), F.lit("_conf.xml")
                 ).alias("conf"), F.col("c_name").alias("owner"))
    return reshape.jobs_with_conf(started, with_job_of_conf(confs))


def job_conf_files(spark, sf):
    """Write a configuration file per customer, read the folder, join it with the jobs."""
    started = read_table(spark, sf, "orders").select(
        run_id(F.col("o_orderkey")).alias("expt_id"),
        render.job_name(F.col("o_custkey")).alias("job_id"))
    path = scratch_path(spark, "job-confs")
    documents = render.conf_documents(read_table(spark, sf, "customer"), "c_custkey", "c_name")
    writers.write_folders(writers.by_folder(documents, ["conf"]), ["conf"], "xml", path)
    confs = read_job_confs(spark, path)
    return reshape.jobs_with_conf(started, confs).select(
        "job_id", "expt_id", "conf", F.col("value").alias("owner"))


# ---- monitor ----------------------------------------------------------------

def iostat(spark, sf, **options):
    return render.iostat_lines(_events(spark, sf), **options)


def disk_samples(spark, sf):
    return monitor.disk_samples(iostat(spark, sf)).select("host", "line_no", *monitor.DISK)


def cpu_samples(spark, sf):
    return monitor.cpu_samples(iostat(spark, sf)).select("host", "line_no", *monitor.CPU)


def cpu_samples_timed(spark, sf):
    samples = monitor.cpu_samples(iostat(spark, sf, timed=True), timed=True)
    return samples.select("host", "line_no", "ts", *monitor.CPU)


def memory_samples(spark, sf):
    lines = render.vmstat_lines(_events(spark, sf))
    return monitor.memory_samples(lines).select("host", "line_no", *monitor.MEMORY)


def memory_sample_files(spark, sf):
    """Timed memory captures, written per host and read back."""
    path = _write_captures(spark, render.vmstat_lines(_events(spark, sf), timed=True), "line_no")
    samples = monitor.memory_samples(read_monitor(spark, path, "memory"), timed=True)
    return samples.select("host", "ts", *monitor.MEMORY)


def disk_sample_files(spark, sf):
    samples = monitor.disk_samples(read_monitor(spark, _capture_files(spark, sf), "disk"), timed=True)
    return samples.select("host", "ts", *monitor.DISK)


def _comparable(df):
    """Means to 7 places, as the order of a sum is open."""
    return df.select(*[F.round(c, 7).alias(c) if c.startswith("avg_") else c for c in df.columns])


def monitor_summary(spark, sf):
    return _comparable(monitor.monitor_summary(
        monitor.disk_samples(iostat(spark, sf)), monitor.DISK))


def cpu_summary(spark, sf):
    samples = monitor.cpu_samples(iostat(spark, sf))
    return _comparable(monitor.monitor_summary(samples, ["user", "idle"]))


def _write_captures(spark, lines, unit, path=None):
    """Captures as files; lines of one unit stay in one file. A path that is there gets more files."""
    path = path or scratch_path(spark, "captures")
    lines.repartitionByRange(shuffle_partitions(spark), "capture", unit).sortWithinPartitions(
        "capture", "line_no").select("capture", "line").write.mode("append").partitionBy("capture").text(path)
    return path


def _capture_files(spark, sf, path=None):
    """Lines of one report share the range key, so every file starts with a whole report."""
    report = F.call_function("div", F.col("line_no"), F.lit(render.REPORT_LINES))
    lines = iostat(spark, sf, timed=True).withColumn("report", report)
    return _write_captures(spark, lines, "report", path)


def cpu_report_files(spark, sf):
    reports = read_cpu_reports(spark, _capture_files(spark, sf))
    return monitor.cpu_report_samples(reports, timed=True)


def stream_samples(spark, sf):
    samples = stream.stream_samples(spark, _capture_files(spark, sf), "disk")
    return stream.drain_samples(samples)


def stream_cpu_samples(spark, sf):
    samples = stream.stream_samples(spark, _capture_files(spark, sf), "cpu")
    return stream.drain_samples(samples)


def stream_utilisation(spark, sf):
    samples = stream.stream_samples(spark, _capture_files(spark, sf), "disk")
    windows = stream.stream_utilisation(samples, monitor.DISK, "1 hour")
    return _comparable(stream.drain_utilisation(windows))


def stream_late_rows(spark, sf):
    """All captures arrive twice; the second time only windows that are still open take them."""
    folder, path, state = _capture_files(spark, sf), scratch_path(spark, "windows"), scratch_path(spark, "state")

    def drain():
        samples = stream.stream_samples(spark, folder, "disk")
        return stream.drain_utilisation(stream.stream_utilisation(samples, monitor.DISK, "1 hour"), path, state)

    drain()
    _capture_files(spark, sf, folder)
    return _comparable(drain())


def stream_redelivered(spark, sf):
    """All captures arrive twice, and every sample counts once."""
    folder = _capture_files(spark, sf)
    once, seen, path, state = (scratch_path(spark, label) for label in ("once", "seen", "windows", "state"))

    def drain():
        samples = stream.drain_once(stream.stream_samples(spark, folder, "disk"), once, seen)
        return stream.drain_utilisation(stream.stream_utilisation(samples, monitor.DISK, "1 hour"), path, state)

    drain()
    _capture_files(spark, sf, folder)
    return _comparable(drain())


def stream_percentiles(spark, sf):
    """High percentiles per host and hour from a stream's sketches, and per day from those of its hours."""
    samples = stream.stream_samples(spark, _capture_files(spark, sf), "disk")
    hours = materialise(stream.drain_utilisation(
        stream.stream_utilisation(samples, monitor.DISK, "1 hour", sketched=True)), "hours")
    days = monitor.merged_windows(hours, monitor.DISK, "day")
    kept = ["window_start", "host", "samples", *monitor.quantiles(monitor.DISK)]
    return hours.select(F.lit("hour").alias("level"), *kept).unionByName(days.select(F.lit("day").alias("level"), *kept))


# ---- generators, sized by the given tables ----------------------------------

def _tasks(spark, size, per_task):
    """Enough tasks for the size, and never fewer than the session would use."""
    return max(shuffle_partitions(spark), math.ceil(size / per_task))


def gen_tpch(spark, sf):
    """All eight tables at the scale of the given line items, counted."""
    scale = read_table(spark, sf, "lineitem").count() / 6_000_000
    tables = generate.gen_tpch(spark, scale, _tasks(spark, scale, 1), zipf=1.0)
    counts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.min(df.columns[0]).cast("long").alias("first_key"),
               F.max(df.columns[0]).cast("long").alias("last_key")
               ).withColumn("tbl", F.lit(name)) for name, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def gen_tpch_values(spark, sf):
    """Every column of all eight tables, made at the scale of the given line items and held to its rule."""
    scale = read_table(spark, sf, "lineitem").count() / 6_000_000
    tables = generate.gen_tpch(spark, scale, _tasks(spark, scale, 1), zipf=1.0)
    rules = domains.domains(generate.table_rows(scale))
    return reduce(DataFrame.unionByName, (domains.check_columns(df, name, rules[name]) for name, df in tables.items()))


def gen_sort_records(spark, sf):
    n = read_table(spark, sf, "orders").count()
    records = generate.gen_sort_records(spark, n, _tasks(spark, n, RECORDS_PER_TASK))
    size = F.octet_length("key") + F.octet_length("rowid") + F.octet_length("filler")
    return records.agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"),
                       F.min(size).alias("smallest"), F.max(size).alias("largest"),
                       F.countDistinct("key").alias("keys"))


def gen_random_text(spark, sf):
    """Sentences for as many bytes as the documents have; word counts per row are checked."""
    size = read_table(spark, sf, "documents").agg(F.sum("n_chars").alias("n")).first()["n"]
    tasks = _tasks(spark, size, TEXT_BYTES_PER_TASK)
    text = generate.gen_random_text(spark, size // tasks, tasks)
    words = [F.size(F.split(c, " ")) for c in ("key", "value")]
    return text.agg(*[f(w).alias(f"{name}_{c}") for w, c in zip(words, ("key", "value"))
                      for name, f in (("min", F.min), ("max", F.max))])


def random_text_like(spark, sf):
    """Random sentences of exactly as many bytes as the documents of each source and language have."""
    sizes = read_table(spark, sf, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("name")).agg(
        F.sum("n_chars").alias("bytes"))
    text = generate.random_text_like(sizes, "name", "bytes")
    words = [F.size(F.split(c, " ")) for c in ("key", "value")]
    inside = [(w >= 5) & (w <= 10) for w in words]
    return text.groupBy("name").agg(
        F.sum(F.octet_length("key") + F.octet_length("value") + 2).alias("bytes"),
        F.count_if(~(inside[0] & inside[1])).alias("odd_rows"))


def zipf_key(spark, sf):
    """Orders per zipf rank when the place of an order is its share of [0, 1)."""
    orders = read_table(spark, sf, "orders")
    u = (F.col("o_orderkey") + 0.5) / F.lit(float(orders.count()))
    return orders.select(zipf_rank(u, 2000, 1.0).alias("rank")).groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"))


# ---- sinks ------------------------------------------------------------------

def write_roundtrip(spark, sf):
    rows = read_table(spark, sf, "lineitem")
    path = scratch_path(spark, "tables")
    writers.write_tables(
        {"lineitem": rows}, path, shuffle_partitions(spark), compression="gzip")
    return spark.read.schema(rows.schema).option("sep", "|").csv(f"{path}/lineitem")


def run_output_roundtrip(spark, sf):
    rows = read_table(spark, sf, "orders")
    prefix = scratch_path(spark, "runs")
    path = writers.write_run(rows, prefix, "EXPT-0000", keep=True, compression="zstd")
    return spark.read.schema(rows.schema).parquet(path)


def kept_outputs(spark, sf):
    """Outputs of the runs of a grid, a third of whose files say that theirs stay; what is found afterwards."""
    third = F.col("file_no") % 3
    rows = specs(spark, sf, "supplier", "s_suppkey").withColumn(
        "delete_on_exit", F.when(third == 0, F.col("delete_on_exit")).when(third == 1, "true"))
    runs = design.expand_design(design.checked_specs(rows))
    outputs = writers.run_outputs(runs).filter("keeps").select("expt_id", "output")
    path = scratch_path(spark, "outputs")
    kept = runs.select("expt_id", "param", "value").join(outputs, "expt_id")
    kept = kept.repartition(writers.folder_tasks(outputs, ["expt_id"]), "expt_id")
    kept.write.options(**writers.COMMIT_IN_TASKS).partitionBy("expt_id").parquet(path)
    with shared_listing(spark):
        found = spark.read.schema(kept.schema).parquet(path)
    return found.groupBy("expt_id", "output").agg(F.count(F.lit(1)).alias("n"))


def tsv_roundtrip(spark, sf):
    rows = read_table(spark, sf, "customer")
    path = scratch_path(spark, "tsv")
    writers.write_tsv(rows, path)
    return read_delimited(spark, path, rows.schema, "\t")


def text_roundtrip(spark, sf):
    """Texts with line ends, tabs and quotes as TSV and back."""
    rows = read_table(spark, sf, "documents")
    path = scratch_path(spark, "tsv")
    writers.write_tsv(rows, path)
    return read_delimited(spark, path, rows.schema, "\t")


def tpch_scan(spark, sf):
    """A table folder of delimited text, read back with the declared schema."""
    rows = read_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int"), "c_name", F.lit(None).cast("string").alias("c_address"), "c_nationkey",
        F.lit("").alias("c_phone"), F.col("c_acctbal").cast("decimal(15,2)"), "c_mktsegment",
        F.concat(F.lit(" padded | "), F.col("c_name"), F.lit("\n")).alias("c_comment"))
    path = scratch_path(spark, "tables")
    writers.write_tables({"customer": rows}, path, 4)
    return read_tpch(spark, f"{path}/customer", "customer").select(
        "c_custkey", "c_name", "c_address", "c_nationkey", "c_phone",
        F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment", "c_comment")


def sequence_roundtrip(spark, sf):
    rows = read_table(spark, sf, "pages").select("page_id", "html")
    path = scratch_path(spark, "sequence")
    writers.write_sequence(
        corpus.repack(rows, corpus.doc_numbers(rows)), "docno", "html", path)
    return writers.read_sequence(spark, path, "docno long, html string")


# ---- corpus -----------------------------------------------------------------

def pages(spark, sf):
    return spread(read_table(spark, sf, "pages"))


def wiki_dump(spark, sf):
    """Write the pages as an XML dump and read it back."""
    path = scratch_path(spark, "dump")
    dump = pages(spark, sf).select(
        F.col("page_id").alias("id"), F.col("url").alias("title"),
        F.struct(F.col("html").alias("text")).alias("revision"))
    dump.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return read_wiki_xml(spark, path)


def plain_text(spark, sf):
    return corpus.plain_text(pages(spark, sf), "html", "html").select("page_id", "plain")


def plain_text_wiki(spark, sf):
    return corpus.plain_text(render.wiki_pages(pages(spark, sf))).select("page_id", "plain")


def link_edges_wiki(spark, sf):
    return corpus.link_edges(render.wiki_pages(pages(spark, sf)), corpus.WIKI_LINK, "title")


def doc_numbers(spark, sf):
    return corpus.doc_numbers(pages(spark, sf))


def repack(spark, sf):
    rows = pages(spark, sf)
    return corpus.repack(rows, corpus.doc_numbers(rows)).select("docno", "url", "html")


def link_edges(spark, sf):
    return corpus.link_edges(pages(spark, sf), corpus.HREF, "url", "html")


def _flat(lists):
    return lists.withColumn("neighbours", F.array_join("neighbours", " "))


def adjacency(spark, sf):
    return _flat(corpus.adjacency(link_edges(spark, sf)))


def bfs_encode(spark, sf):
    source = pages(spark, sf).agg(F.min("url").alias("url")).first()["url"]
    return _flat(corpus.bfs_encode(corpus.adjacency(link_edges(spark, sf)), source))


def _supply_edges(spark, sf):
    """The graph that links every part with its suppliers."""
    line = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    pairs = corpus.distinct_rows(line, line.count())
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return pairs.select(F.explode(F.array(
        F.struct(part.alias("src"), supplier.alias("dst")),
        F.struct(supplier.alias("src"), part.alias("dst")))).alias("e")).select("e.src", "e.dst")


def adjacency_parts(spark, sf):
    """Lists of at most some ten neighbours a part; unfolded they are the edges again."""
    lists = corpus.adjacency(_supply_edges(spark, sf), neighbours_per_row=10)
    return lists.select(F.col("node").alias("src"), F.explode("neighbours").alias("dst"))


def bfs(spark, sf):
    """Hops from part 0 to every part and supplier."""
    return corpus.bfs(_supply_edges(spark, sf), "p0")


QUERIES = [
    attempt_times, map_attempt_times, reduce_attempt_times, attempt_report, attempt_rejects,
    attempts_of, spill_gaps, job_summary, logs_for_runs, shuffle_transfers, latest_attempts,
    job_ids, run_job_map, job_run_times, client_log_files, manifest_roundtrip,
    experiment_stats, sort_stats, design_expand, design_ids, design_size, design_total,
    spec_values, spec_violations, run_order, run_order_shuffled, union_designs, design_tsv,
    run_conf_documents, run_confs_roundtrip, total_sort, word_count, join_merge, join_broadcast, join_salted,
    join_partsupp, merge_horizontal, pair_runs, resolve_profiles, unify, unify_last_wins,
    jobs_with_conf, disk_samples, cpu_samples, cpu_samples_timed, cpu_report_files,
    memory_samples,
    monitor_summary, cpu_summary, stream_samples, stream_cpu_samples, stream_utilisation,
    gen_tpch, gen_tpch_values, gen_sort_records, gen_random_text, zipf_key, write_roundtrip,
    run_output_roundtrip, tsv_roundtrip, text_roundtrip, tpch_scan, sequence_roundtrip, wiki_dump, plain_text, doc_numbers, repack,
    link_edges, adjacency, bfs_encode, bfs,
    attempt_log_files, disk_sample_files, memory_sample_files, spec_files, job_conf_files, text_corpus,
    unify_files, join_reducers, stream_late_rows, plain_text_wiki, link_edges_wiki, adjacency_parts,
    run_list_file, shared_profile, kept_outputs, unify_packed, stream_redelivered, stream_percentiles, random_text_like,
]
