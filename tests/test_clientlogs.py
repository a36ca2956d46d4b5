from runledger.operators import clientlogs
from runledger.operators.design import stats_row
from runledger.sources import lines as sources
from runledger.sources import specs

RUNNING = " INFO mapred.JobClient: Running job: "
COMPLETE = " INFO mapred.JobClient: Job complete: "


def client(spark, rows):
    return spark.createDataFrame(
        [(run, i, line) for i, (run, line) in enumerate(rows)],
        "expt_id string, line_no long, line string")


def test_job_times(spark):
    lines = client(spark, [
        ("EXPT-0000", "10/05/10 15:05:06" + RUNNING + "job_201005101219_0006"),
        ("EXPT-0000", "10/05/10 16:01:45" + COMPLETE + "job_201005101219_0006"),
        ("EXPT-0000", "10/05/10 16:02:00" + RUNNING + "job_201005101219_0007"),
        ("EXPT-0001", "69/12/31 23:59:59" + RUNNING + "job_1_1"),
        ("EXPT-0001", "70/01/01 00:00:01" + COMPLETE + "job_1_1"),
        ("EXPT-0002", "68/01/01 00:00:00" + RUNNING + "job_1_2"),
        ("EXPT-0002", "68/01/01 00:00:09" + COMPLETE + "job_1_2"),
        ("EXPT-0003", "10/05/10 16:01:45" + COMPLETE + "job_1_3"),
    ])
    times = {(r.expt_id, r.job_id): (r.seconds, r.started.year)
             for r in clientlogs.job_run_times(lines).collect()}
    assert times == {
        ("EXPT-0000", "job_201005101219_0006"): (3399, 2010),
        ("EXPT-0000", "job_201005101219_0007"): (None, 2010),
        ("EXPT-0001", "job_1_1"): (2, 1969),
        ("EXPT-0002", "job_1_2"): (9, 2068)}


def test_job_ids_keep_all_jobs_of_a_run(spark):
    lines = client(spark, [
        ("EXPT-0000", "10/05/10 15:05:06" + RUNNING + "job_1_1"),
        ("EXPT-0000", "10/05/10 15:05:06" + RUNNING + "job_1_2"),
        ("EXPT-0001", "Running without a job"),
        ("EXPT-0001", "10/05/10 15:05:06" + RUNNING + "job_1_3 later text"),
    ])
    runs = spark.createDataFrame([("EXPT-0000",), ("EXPT-0001",), ("EXPT-0002",)], "expt_id string")
    found = clientlogs.run_job_map(runs, clientlogs.extract_job_ids(lines)).collect()
    assert sorted((r.expt_id, r.job_id or "") for r in found) == [
        ("EXPT-0000", "job_1_1"), ("EXPT-0000", "job_1_2"), ("EXPT-0001", ""), ("EXPT-0002", "")]


def test_files(spark, tmp_path):
    for run in ("EXPT-0000", "EXPT-0001"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "output.txt").write_text(
            "10/05/10 15:05:06" + RUNNING + f"job_1_{run[-1]}\n")
    lines = sources.read_client_logs(spark, f"{tmp_path}/EXPT-*/output.txt")
    found = clientlogs.extract_job_ids(lines).collect()
    assert sorted(map(tuple, found)) == [("EXPT-0000", "job_1_0"), ("EXPT-0001", "job_1_1")]
    (tmp_path / "ids.txt").write_text(
        "EXPT_ID\tHADOOP_JOB_ID\n EXPT-0000\tjob_1_0 \nEXPT-0001\tNull\n")
    manifest = specs.read_manifest(spark, str(tmp_path / "ids.txt")).collect()
    assert sorted((r.expt_id, r.job_id or "") for r in manifest) == [
        ("EXPT-0000", "job_1_0"), ("EXPT-0001", "")]
    (tmp_path / "list.txt").write_text("EXPT-0001\n\n  EXPT-0000  \n")
    runs = specs.read_run_list(spark, str(tmp_path / "list.txt")).orderBy("run_order").collect()
    assert [r.expt_id for r in runs] == ["EXPT-0001", "EXPT-0000"]
    (tmp_path / "host_12_job_1_0_conf.xml").write_text(
        "<configuration><property><name>a</name><value> 1 </value></property>"
        "<property><name>b</name><value>2</value></property></configuration>")
    confs = specs.read_job_confs(spark, str(tmp_path)).collect()
    assert sorted((r.job_id, r.name, r.value) for r in confs) == [
        ("job_1_0", "a", " 1 "), ("job_1_0", "b", "2")]


def test_stats_row_takes_first_words(spark):
    design = spark.createDataFrame(
        [("EXPT-0000", 0, 1, "MAPREDUCE_JOBCONF", " -Xmx1m -server"),
         ("EXPT-0000", 0, 0, "MAPREDUCE_JOBCONF", "10"),
         ("EXPT-0000", 0, 2, "HADOOP_JAR", "/jar"),
         ("EXPT-0000", 0, 3, "MAPREDUCE_JOBCONF", "")],
        "expt_id string, run_no long, pos long, type string, value string")
    assert stats_row(design).first().settings == ["10", "-Xmx1m", ""]


def test_one_pass_over_client_output_says_the_same(spark):
    stamp = "10/01/01 00:00:%02d INFO mapred.JobClient: "
    rows = [("r1", stamp % 1 + "Running job: job_1_2"), ("r1", stamp % 9 + "Job complete: job_1_2"),
            ("r1", stamp % 2 + "Running job: job_1_3"), ("r1", stamp % 3 + "Running job: job_1_2"),
            ("r2", "nothing here"), ("r2", stamp % 4 + "Job complete: job_9_9"),
            ("r3", stamp % 5 + "Running job_3_1 before job_3_2"), ("r3", stamp % 7 + "Job complete: job_3_1"),
            ("r4", stamp % 5 + "Running jobs"), ("r5", None), ("r6", "Running job: job_6_1")]
    lines = spark.createDataFrame(rows, "expt_id string, line string")
    jobs = clientlogs.run_job_map(lines, clientlogs.extract_job_ids(lines))
    two = jobs.join(clientlogs.job_run_times(lines).select("expt_id", "job_id", "seconds"), ["expt_id", "job_id"], "left")
    one = clientlogs.client_jobs(lines)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, one.collect()), key=key) == sorted(map(tuple, two.select(one.columns).collect()), key=key)
    assert ("r2", None, None) in set(map(tuple, one.collect()))
    assert ("r1", "job_1_2", 8) in set(map(tuple, one.collect()))
