import os

import pytest
from pyspark.sql import functions as F

from runledger.operators import monitor
from runledger.sources.lines import read_cpu_reports, read_monitor
from runledger.streaming import monitor as stream

HEADER = "avg-cpu:  %user   %nice %system %iowait  %steal   %idle"
IOSTAT = [
    "Linux 2.6 (host)  01/01/2010", "", HEADER,
    "          15.48    0.10    5.18   25.57    2.52   51.15", "",
    "Device:            tps    MB_read/s    MB_wrtn/s    MB_read    MB_wrtn",
    "sda1 1 2 3 4 5", "sda2             12.00        10.88        13.40         32         40",
    HEADER, HEADER, "1 2 3 4 5 6", HEADER, "", "7 8 9 10 11 12", "sda2 short", HEADER]
VMSTAT = [
    "procs -----------memory---------- ---swap-- -----io----",
    " r  b   swpd   free   buff  cache   si   so    bi    bo", "",
    " 1  0     28  32276   4808 1628932    0    0     1     2", "1 0 x 1 2 3 4", "1 0 5"]


def lines(spark, texts, timed=False):
    rows = [("h1", "c", i, f"{100 + i} {t}" if timed else t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "host string, capture string, line_no long, line string")


@pytest.mark.parametrize("timed", [False, True])
def test_disk_and_memory(spark, timed):
    disk = monitor.disk_samples(lines(spark, IOSTAT, timed), timed=timed).collect()
    assert [(r.line_no, r.mb_read, r.mb_write) for r in disk] == [(7, 10.88, 13.40)]
    other = monitor.disk_samples(lines(spark, IOSTAT, timed), "sda1", timed).collect()
    assert [(r.mb_read, r.mb_write) for r in other] == [(2.0, 3.0)]
    memory = monitor.memory_samples(lines(spark, VMSTAT, timed), timed=timed).collect()
    assert [(r.swpd, r.free, r.buff, r.cache) for r in memory] == [(28, 32276, 4808, 1628932)]
    if timed:
        assert disk[0].ts.timestamp() == 107


@pytest.mark.parametrize("width", [1, 2, 3, 5, 1000])
@pytest.mark.parametrize("timed", [False, True])
def test_cpu_takes_the_next_line(spark, width, timed):
    found = monitor.cpu_samples(lines(spark, IOSTAT, timed), timed, width).orderBy("line_no")
    values = [(r.line_no, r.user, r.idle) for r in found.collect()]
    assert values == [(3, 15.48, 51.15), (10, 1.0, 6.0)]
    if timed:
        assert [r.ts.timestamp() for r in found.collect()] == [103, 110]


def test_cpu_lines_are_shuffled_once(spark, tmp_path):
    spark.range(2000).select(
        F.lit("h").alias("host"), F.lit("c").alias("capture"), F.col("id").alias("line_no"),
        F.when(F.col("id") % 2 == 0, HEADER).otherwise("1 2 3 4 5 6").alias("line")
    ).write.parquet(str(tmp_path / "lines"))
    df = monitor.cpu_samples(spark.read.parquet(str(tmp_path / "lines")), chunk_width=100)
    assert df.count() == 1000
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_summary(spark):
    samples = spark.range(1, 101).select(
        F.concat(F.lit("h"), F.col("id") % 2).alias("host"), F.col("id").cast("double").alias("x"))
    row = monitor.monitor_summary(samples, ["x"]).filter("host = 'h0'").first()
    assert (row.samples, row.avg_x, row.max_x, row.p95_x) == (50, 51.0, 100.0, 96.0)


def write(folder, name, texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(texts) + "\n")


def test_capture_files_and_stream_agree(spark, tmp_path):
    for host in ("n1", "n2"):
        write(tmp_path, f"iostat_output-{host}", [f"{100 + i} {t}" for i, t in enumerate(IOSTAT)])
        write(tmp_path, f"vmstat_output-{host}", [f"{100 + i} {t}" for i, t in enumerate(VMSTAT)])
    batch = {"disk": monitor.disk_samples, "memory": monitor.memory_samples}
    for kind, parse in batch.items():
        rows = parse(read_monitor(spark, str(tmp_path), kind), timed=True)
        streamed = stream.drain_samples(stream.stream_samples(spark, str(tmp_path), kind))
        assert sorted(map(tuple, rows.select(streamed.columns).collect())) == sorted(
            map(tuple, streamed.collect()))
        assert {r.host for r in streamed.collect()} == {"n1", "n2"}
    cpu = stream.drain_samples(stream.stream_samples(spark, str(tmp_path), "cpu"))
    found = [(r.ts.timestamp(), r.user, r.idle)
             for r in cpu.filter("host = 'n1'").orderBy("ts").collect()]
    assert found == [(103, 15.48, 51.15), (110, 1.0, 6.0)]
    with pytest.raises(ValueError, match="kind"):
        read_monitor(spark, str(tmp_path), "net")


@pytest.mark.parametrize("split", [64, 100, 1000])
def test_reports_are_cut_right_over_splits(spark, tmp_path, split):
    write(tmp_path, "iostat_output-n1", IOSTAT * 20)
    old = {k: spark.conf.get(k) for k in
           ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in old:
            spark.conf.set(key, f"{split}b")
        cut = monitor.cpu_report_samples(read_cpu_reports(spark, str(tmp_path)))
        by_line = monitor.cpu_samples(read_monitor(spark, str(tmp_path), "cpu"), chunk_width=7)
        assert cut.count() == by_line.count() == 40
        assert sorted(r.user for r in cut.collect()) == sorted(r.user for r in by_line.collect())
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("timed", [False, True])
def test_reports_are_split_once_for_all_uses(spark, timed):
    reports = spark.createDataFrame([("n", "  %user x\n 5 1 2 3 4 5 6\n"), ("n", "  %user\n5 1 2\n"), ("n", "x\n1 2 3 4 5 6 7"), ("n", None)],
                                    "host string, report string")
    found = monitor.cpu_report_samples(reports, timed=timed).filter("user > 0 and idle > 0")
    assert [r.idle for r in found.collect()] == [6.0 if timed else 5.0]
    # Behind a filter, the expressions of a sample used to be written out for every use.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2


def test_late_rows_are_dropped(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"

    def disk(second):
        return f"{second} sda2 1 2.0 3.0 4 5"

    write(folder, "iostat_output-a", [disk(0), disk(30), disk(600)])
    os.utime(folder / "iostat_output-a", (1000, 1000))
    write(folder, "iostat_output-b", [disk(700)])
    os.utime(folder / "iostat_output-b", (2000, 2000))
    write(folder, "iostat_output-c", [disk(10), disk(1300)])
    os.utime(folder / "iostat_output-c", (3000, 3000))
    samples = stream.stream_samples(spark, str(folder), "disk", files_per_trigger=1)
    windows = stream.stream_utilisation(samples, ["mb_read"], "1 minute", "2 minutes")
    closed = stream.drain_samples(windows, str(out)).collect()
    # c's line at second 10 comes after the watermark has passed its window.
    assert {(r.host, int(r.window_start.timestamp()), r.samples) for r in closed} == {
        ("a", 0, 2), ("a", 600, 1), ("b", 660, 1)}


def test_drained_windows_honour_the_watermark_over_restarts(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def disk(second, value):
        return f"{second} sda2 1 {value} 3.0 4 5"

    def drained():
        samples = stream.stream_samples(spark, folder, "disk")
        windows = stream.stream_utilisation(samples, ["mb_read"], "1 minute", "2 minutes")
        rows = stream.drain_utilisation(windows, out, state).collect()
        return {(r.host, int(r.window_start.timestamp())): (r.samples, r.max_mb_read) for r in rows}

    write(tmp_path / "in", "iostat_output-a", [disk(0, 1), disk(30, 2), disk(600, 3)])
    assert drained() == {("a", 0): (2, 2.0), ("a", 600): (1, 3.0)}
    # Second 10 is behind the watermark of 480, second 610 is in a window that is still open.
    write(tmp_path / "in", "iostat_output-b", [disk(10, 9)])
    write(tmp_path / "in", "more-iostat_output-a", [disk(20, 9), disk(610, 9)])
    assert drained() == {("a", 0): (2, 2.0), ("a", 600): (2, 9.0)}
    assert drained() == {("a", 0): (2, 2.0), ("a", 600): (2, 9.0)}


def test_percentile_is_a_value_of_the_host(spark):
    samples = spark.range(1, 101).selectExpr("'n' as host", "cast(id as double) as mb_read")
    assert monitor.monitor_summary(samples, ["mb_read"]).first().p95_mb_read == 95.0


def test_drained_windows_of_an_empty_folder(spark, tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()
    windows = stream.stream_utilisation(stream.stream_samples(spark, str(folder), "disk"), monitor.DISK, "10 minutes")
    assert stream.drain_utilisation(windows).collect() == []


def disk_line(second, value):
    return f"{second} sda2 1 {value} 3.0 4 5"


def test_a_capture_that_is_delivered_again_counts_once(spark, tmp_path):
    folder, once, seen, out, state = (str(tmp_path / n) for n in ("in", "once", "seen", "out", "state"))

    def drained():
        samples = stream.drain_once(stream.stream_samples(spark, folder, "disk"), once, seen)
        rows = stream.drain_utilisation(stream.stream_utilisation(samples, ["mb_read"]), out, state).collect()
        return {(r.host, int(r.window_start.timestamp())): (r.samples, r.max_mb_read) for r in rows}

    first = [disk_line(1, 1), disk_line(30, 2), disk_line(600, 3), disk_line(600, 3)]
    write(tmp_path / "in", "iostat_output-a", first)
    expected = {("a", 0): (2, 2.0), ("a", 600): (1, 3.0)}
    assert drained() == expected
    # The same lines again, closed windows and open ones alike, and one new sample in an open window.
    write(tmp_path / "in", "again-iostat_output-a", first)
    assert drained() == expected
    write(tmp_path / "in", "third-iostat_output-a", [*first, disk_line(610, 3)])
    write(tmp_path / "in", "iostat_output-b", [disk_line(600, 3)])
    assert drained() == {("a", 0): (2, 2.0), ("a", 600): (2, 3.0), ("b", 600): (1, 3.0)}


def test_sketches_of_windows_merge_to_those_of_a_day(spark):
    # 40,000 samples a host and day, in an order that has nothing to do with their size; host h2 has no value.
    n = 40_000
    samples = spark.range(2 * n).selectExpr(
        "concat('h', id % 2) as host", "timestamp_seconds(id % 86400) as ts", "(id * 7919 % 80000) / 8 as x").unionByName(
        spark.sql("select 'h2' as host, timestamp_seconds(5) as ts, cast(null as double) as x"))
    hours = samples.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "host").agg(
        F.count(F.lit(1)).alias("samples"), *monitor.sketches(["x"]))
    days = monitor.merged_windows(hours, ["x"], "day").select("host", "samples", *monitor.quantiles(["x"])).collect()
    found = {r.host: (r.samples, r.p95_x) for r in days}
    assert found["h2"] == (1, None)
    for host in ("h0", "h1"):
        values = sorted(r.x for r in samples.filter(F.col("host") == host).collect())
        assert found[host][0] == n
        below = sum(v <= found[host][1] for v in values) / n
        assert abs(below - 0.95) < 0.005


def test_small_windows_have_exact_percentiles(spark):
    samples = spark.range(1, 101).selectExpr("'n' as host", "timestamp_seconds(id) as ts", "id as x")
    hours = samples.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "host").agg(
        F.count(F.lit(1)).alias("samples"), *monitor.sketches(["x"]))
    assert hours.select(*monitor.quantiles(["x"])).first()[0] == 95.0
    assert hours.select(*monitor.quantiles(["x"], 0.5)).first()["p50_x"] == 50.0
