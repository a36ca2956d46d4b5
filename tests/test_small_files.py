"""Trees of many small files are written and read by tasks, with the rows that Spark's own reader and writer give."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from runledger.plans import catalog
from runledger.session import scratch_path
from runledger.sinks import folders, writers
from runledger.sources import files, specs
from runledger.sources.lines import read_artifacts, read_attempt_logs, read_file_lines, read_lines

SF = "/root/testdata/sf0.001"
ATTEMPT = "attempt_202401010000_%04d_m_000000_0"


def visible(folder):
    return sorted(os.path.relpath(os.path.join(at, name), folder) for at, _, names in os.walk(folder) for name in names
                  if not name.startswith((".", "_")))


def hidden(folder):
    return [name for _, _, names in os.walk(folder) for name in names if name.startswith(".")]


def written_by(spark, query, label):
    scratch = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    rows = query(spark, SF).collect()
    (folder,) = [name for name in set(os.listdir(scratch)) - before if name.startswith(f"{label}-")]
    return os.path.join(scratch, folder), rows


def test_attempt_logs_cost_one_file_each(spark):
    # A second file per log, and a process to set the rights of each, took most of the time.
    folder, rows = written_by(spark, catalog.attempt_log_files, "attempt-logs")
    attempts = catalog.attempt_lines(spark, SF).select("host", "attempt_id").distinct().count()
    assert len(visible(folder)) == attempts == len({os.path.dirname(f) for f in visible(folder)}) and rows
    assert hidden(folder) == [] and os.path.exists(f"{folder}/_SUCCESS")


def test_read_as_by_spark(spark, tmp_path):
    texts = {"plain": b"a\nb\n", "open end": b"a\nb", "returns": b"a\r\nb\rc\n\nd\r\n", "blank": b"\n", "empty": b"", "mark": b"\xef\xbb\xbfa\n",
             "odd %é#": "ü 100%\n".encode(), "EXPT-1/deep/er": b"deep\n", "_kept=1/f": b"kept\n", "_left/f": b"left\n", ".left": b"left\n",
             "packed.gz": gzip.compress(b"a\nb\n")}
    for name, content in texts.items():
        (tmp_path / "x" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "x" / name).write_bytes(content)
    for pattern in ("x/*", "{x,y}/*", "[!y]/[a-zE]*"):
        path = f"{tmp_path}/{pattern}"
        mine, theirs = ([(r.name, r.line) for r in read(spark, path, name=r"([^/]+)$").filter("name != 'f' or line != 'left'").orderBy(
            "name", "line_no").collect()] for read in (read_file_lines, read_lines))
        assert mine == theirs and len(mine) > 4
    whole = files.read_small_files(spark, f"{tmp_path}/x/*", F.lit(0).cast("long"), whole=True)
    theirs = spark.read.text(f"{tmp_path}/x/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    left = ~F.col("path").contains("_left")
    assert sorted(map(tuple, whole.filter(left).select("path", "value").collect())) == sorted(map(tuple, theirs.filter(left).collect()))


def test_large_files_are_left_to_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SMALL_FILE", 100)
    for run, lines in enumerate((2, 500, 3)):
        (tmp_path / f"r{{{run}}}").mkdir()
        (tmp_path / f"r{{{run}}}" / "log").write_text("".join(f"{run} {i}\n" for i in range(lines)))
    rows = read_file_lines(spark, f"{tmp_path}/*/log").orderBy("line").collect()
    assert [r.line for r in rows] == sorted(f"{run} {i}" for run, n in enumerate((2, 500, 3)) for i in range(n))
    big = sorted((r.line_no, int(r.line[2:])) for r in rows if r.line[0] == "1")
    assert [i for _, i in big] == list(range(500))


def test_what_is_not_there_is_an_error(spark, tmp_path):
    for pattern in ("none/*", "*.log"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read_file_lines(spark, f"{tmp_path}/{pattern}").collect()


def test_files_follow_tasks_of_many_files(spark, tmp_path):
    for run in range(300):
        (tmp_path / f"host=h/attempt_id={ATTEMPT % run}").mkdir(parents=True)
        (tmp_path / f"host=h/attempt_id={ATTEMPT % run}/part-0").write_text(f"{run}\n")
    rows = read_attempt_logs(spark, f"{tmp_path}/*/*")
    # The driver holds no list of files, and a task reads more than the some 30 files of Spark's packing.
    assert "FileScan text" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.rdd.getNumPartitions() <= 8
    assert sorted((r.attempt_id, r.host, r.line_no, r.line) for r in rows.collect()) == [(ATTEMPT % i, "h", 0, str(i)) for i in range(300)]


def test_folders_as_spark_names_and_fills_them(spark, tmp_path):
    values = ["a", "", None, "a b", "x=1/2", "50%", "[q]'s:*?#{}^\\\"", "ü", "EXPT-0001"]
    rows = spark.createDataFrame([(v, i % 2, i, text) for v in values for i, text in enumerate(["first", None, "", "last", "ü"])],
                                 "k string, n int, at int, line string")
    dealt = writers.by_folder(rows, ["k", "n"], ["at"], 3)
    writers.write_folders(dealt, ["k", "n"], "line", str(tmp_path / "mine"))
    dealt.select("k", "n", "line").write.partitionBy("k", "n").text(str(tmp_path / "spark"))

    def content(folder):
        return {os.path.dirname(name): (folder / name).read_bytes() for name in visible(folder)}
    # Spark has one file per folder here, as all rows of a key are in one task.
    assert content(tmp_path / "mine") == content(tmp_path / "spark")
    with pytest.raises(ValueError, match="already exists"):
        writers.write_folders(dealt, ["k", "n"], "line", str(tmp_path / "mine"))


def test_rows_in_any_order_and_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(0, 100, 1, 1).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("string").alias("line"))
        writers.write_folders(rows, ["k"], "line", str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(visible(tmp_path / "t")) == 3
    for k in range(3):
        assert (tmp_path / f"t/k={k}/part-00000.txt").read_text().split() == [str(i) for i in range(100) if i % 3 == k]


def test_a_failed_job_leaves_nothing_that_a_reader_sees(spark, tmp_path):
    rows = spark.range(0, 20, 1, 1).select(F.col("id").cast("string").alias("k"), F.when(
        F.col("id") == 15, F.raise_error(F.lit("broken"))).otherwise("x").alias("line"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        with pytest.raises(Exception, match="broken"):
            writers.write_folders(rows, ["k"], "line", str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert visible(tmp_path / "t") == [] and not (tmp_path / "t" / "_SUCCESS").exists()


def test_a_repeated_attempt_replaces_whole_files(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import types as T

    class Task:
        partitionId = staticmethod(lambda: 4)

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task))
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("line", T.StringType())])
    batch = pa.RecordBatch.from_pydict({"k": ["a", "a", "b"], "line": ["1", "2", "3"]})
    for _ in range(2):
        assert folders.FolderWriter(schema, str(tmp_path), ".txt").write(iter([batch])).files == 2
    assert visible(tmp_path) == ["k=a/part-00004.txt", "k=b/part-00004.txt"] and hidden(tmp_path) == []
    assert (tmp_path / "k=a/part-00004.txt").read_text() == "1\n2\n"


def test_stores_that_only_spark_opens(spark, tmp_path):
    root = "viewfs://small/in"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.small.link./in", f"file://{tmp_path}")
    assert not files.opens(root)
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, line string")
    writers.write_folders(rows, ["k"], "line", f"{root}/t")
    assert sorted((r.k, r.line) for r in read_file_lines(spark, f"{root}/t/*", k="k=([^/]+)").collect()) == [("a", "1"), ("b", "2")]


def test_job_confs_cost_one_file_each(spark):
    folder, rows = written_by(spark, catalog.job_conf_files, "job-confs")
    customers = catalog.read_table(spark, SF, "customer").select("c_custkey").distinct().count()
    assert len(visible(folder)) == customers and hidden(folder) == [] and rows
    plan = specs.read_job_confs(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "MapInArrow" in plan


def test_run_confs_cost_one_file_each(spark, tmp_path):
    rows = [("EXPT-0000", 0, "a", "1"), ("EXPT-0000", 1, "b", " <2> & \"x\"\n"), ("EXPT-0001", 0, "a", ""), ("EXPT-0001", 2, "c", "3"),
            ("EXPT-0001", 1, "b", "ü"), ("EXPT-0001", 1, "b", "ü"), ("EXPT-0002", 0, "n", None)]
    table = spark.createDataFrame([(*row, "MAPREDUCE_JOBCONF") for row in rows], "expt_id string, pos int, param string, value string, type string")
    writers.write_run_confs(table, str(tmp_path / "mine"), 2)
    writers.write_run_confs(table, str(tmp_path / "packed"), 2, "gzip")
    assert len(visible(tmp_path / "mine")) == 3 and hidden(tmp_path / "mine") == []
    for name in visible(tmp_path / "packed"):
        # The documents are those of Spark's XML writer, which still writes the compressed ones.
        (mine,) = (tmp_path / "mine" / name).parent.parent.glob(f"{os.path.dirname(name)}/part-*.xml")
        assert mine.read_bytes().rstrip() == gzip.decompress((tmp_path / "packed" / name).read_bytes()).rstrip()
    back = [sorted(map(tuple, specs.read_run_confs(spark, str(tmp_path / of)).collect()), key=str) for of in ("mine", "packed")]
    assert back[0] == back[1] and len(back[0]) == len(rows)


def test_artifacts_cost_one_file_each(spark):
    folder, rows = written_by(spark, catalog.unify_files, "artifacts")
    kinds = catalog.render.artifacts(catalog._events(spark, SF)).select("expt_id", "kind").distinct().count()
    assert len(visible(folder)) == kinds and hidden(folder) == [] and rows
    plan = read_artifacts(spark, folder, "userlogs")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "MapInArrow" in plan
