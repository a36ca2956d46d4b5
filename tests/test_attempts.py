import os

import pytest

from runledger.operators import attempts
from runledger.sources import lines as sources

A = "attempt_201001231500_0003_m_000036_1"
R = "attempt_201001052153_0021_r_000001_0"
START = "2010-01-23 15:27:00,940 INFO metrics.jvm.JvmMetrics: Initializing processName=MAP"
SPILL = "2010-01-23 15:27:05,710 INFO mapred.MapTask: Finished spill "
COMMIT = (f"2010-01-23 15:27:27,429 INFO mapred.TaskRunner: Task:{A} is done. "
          "And is in the process of commiting")
DONE = f"2010-01-23 15:27:27,459 INFO mapred.TaskRunner: Task '{A}' done."
CLEANUP = "2010-01-23 15:27:20,369 INFO metrics.jvm.JvmMetrics: processName=CLEANUP, sessionId="


def log(spark, texts, attempt=A, host="h1"):
    rows = [(host, attempt, i, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "host string, attempt_id string, line_no long, line string")


def outcome(spark, texts):
    row = attempts.map_attempt_times(log(spark, texts)).first()
    return row and (row.seconds, row.status)


@pytest.mark.parametrize("texts, expected", [
    ([START, SPILL + "0", COMMIT, DONE], (27, "SUCCESSFUL")),
    ([START, SPILL + "0", COMMIT], (27, "FAILED|KILLED")),
    ([START, SPILL + "0", DONE], (27, "FAILED|KILLED")),
    ([START, COMMIT, DONE], (27, "FAILED|KILLED")),
    ([START, SPILL + "0", CLEANUP, COMMIT, DONE], (27, "FAILED|KILLED")),
    ([CLEANUP, SPILL + "0", COMMIT, DONE], (7, "SUCCESSFUL")),
    ([SPILL + "0", COMMIT, DONE], (22, "FAILED|KILLED")),
    ([START], (0, "FAILED|KILLED")),
    (["no time", SPILL + "0", COMMIT, DONE], None),
    ([START, SPILL + "0", COMMIT, DONE, "\tat some.Frame"], None),
    ([START, "\tat some.Frame", SPILL + "0", COMMIT, DONE], (27, "SUCCESSFUL")),
])
def test_map_outcomes(spark, texts, expected):
    assert outcome(spark, texts) == expected


def test_lines_of_other_attempts_set_no_flag(spark):
    other = DONE.replace("000036", "000037")
    assert outcome(spark, [START, SPILL + "0", COMMIT, other])[1] == "FAILED|KILLED"


def test_reduce_outcomes(spark):
    start = "2010-01-06 12:18:01,011 INFO jvm.JvmMetrics: processName=SHUFFLE, sessionId="
    commit = (f"2010-01-06 12:59:50,963 INFO mapred.TaskRunner: Task:{R} is done. "
              "And is in the process of commiting")
    saved = (f"2010-01-06 12:59:53,038 INFO mapred.FileOutputCommitter: Saved output of task '{R}'"
             " to /out")

    def row(texts):
        found = attempts.reduce_attempt_times(log(spark, texts, R)).first()
        return found.seconds, found.status, found.cleanup_conflict

    # The line that announces the commit has the words of a finished task as well.
    assert row([start, commit, saved]) == (2512, "SUCCESSFUL", False)
    assert row([start, saved])[1:] == ("FAILED|KILLED", False)
    assert row([start, CLEANUP, commit, saved])[1:] == ("SUCCESSFUL", True)
    assert row([start, CLEANUP, saved])[1:] == ("FAILED|KILLED", False)


def test_rejects(spark):
    good = log(spark, [START, DONE])
    late = log(spark, [START, "broken"], A.replace("36", "37"))
    early = log(spark, ["broken", DONE], A.replace("36", "38"))
    files = spark.createDataFrame([("h1", A, 10), ("h2", A.replace("36", "39"), 0)],
                                  "host string, attempt_id string, length long")
    found = attempts.attempt_rejects(good.union(late).union(early), files).collect()
    assert {(r.attempt_id[-8:], r.reason) for r in found} == {
        ("000037_1", "no time on the last line"), ("000038_1", "no time on the first line"),
        ("000039_1", "empty log")}


@pytest.mark.parametrize("width", [1, 2, 3, 1000])
def test_spill_gaps_do_not_depend_on_chunks(spark, width):
    texts = [START, SPILL + "0", "x", SPILL + "2", SPILL + "3", "y", "z", SPILL + "3", SPILL + "4"]
    found = attempts.spill_gaps(log(spark, texts), width).orderBy("line_no").collect()
    assert [(r.line_no, r.spill, r.expected) for r in found] == [(3, 2, 1), (7, 3, 4)]
    # A spill on the first line is not seen, the next one counts as a gap.
    found = attempts.spill_gaps(log(spark, [SPILL + "0", SPILL + "1", SPILL + "2"]), width).collect()
    assert [(r.line_no, r.spill, r.expected) for r in found] == [(1, 1, 0)]


def test_job_and_phase_filter(spark):
    lines = log(spark, [START]).union(log(spark, [START], R))
    assert attempts.attempts_of(lines, "job_201001231500_0003", "m").count() == 1
    assert attempts.attempts_of(lines, "201001052153_0021").count() == 1
    assert attempts.attempts_of(lines, "201001052153_0021", "m").count() == 0


def test_transfers_are_case_sensitive_and_reduce_only(spark):
    texts = ["Shuffling 1", "shuffling 2", "Read 3", "Failed 4", "other"]
    lines = log(spark, texts, R).union(log(spark, texts, A))
    found = attempts.shuffle_transfers(lines, "job_201001052153_0021").collect()
    assert sorted(r.line for r in found) == ["Failed 4", "Read 3", "Shuffling 1"]


def test_report_line(spark):
    rows = attempts.map_attempt_times(log(spark, [START, SPILL + "0", COMMIT, DONE]))
    line = rows.select(attempts.report_line().alias("line")).first().line
    assert line == f"{A},    27, SUCCESSFUL"


def test_logs_are_read_in_file_order_over_many_splits(spark, tmp_path):
    base = tmp_path / "logs"
    for host in ("hostA", "hostB"):
        folder = base / host / "userlogs" / A
        folder.mkdir(parents=True)
        texts = [START, *[f"{SPILL}{i}" for i in range(300)], COMMIT, DONE]
        (folder / "syslog").write_text("\n".join(texts) + "\n")
    empty = base / "hostA" / "userlogs" / R
    empty.mkdir()
    (empty / "syslog").write_text("")
    old = {k: spark.conf.get(k) for k in
           ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1kb")
        lines = sources.read_attempt_logs(spark, f"{base}/*/userlogs/*/syslog")
        assert lines.rdd.getNumPartitions() > 5
        assert {r.host for r in lines.select("host").distinct().collect()} == {"hostA", "hostB"}
        assert attempts.spill_gaps(lines, 50).count() == 0
        assert [r.seconds for r in attempts.map_attempt_times(lines).collect()] == [27, 27]
        for row in lines.groupBy("host").agg({"line_no": "count"}).collect():
            assert row[1] == 303
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    os.utime(base / "hostB" / "userlogs" / A / "syslog", (1, 1))
    newest = attempts.latest_attempts(
        sources.attempt_files(spark, f"{base}/*/userlogs/{A}/syslog")).collect()
    assert [r.host for r in newest] == ["hostA", "hostB"]


def test_glob_opens_only_the_logs_of_a_job(spark, tmp_path):
    for attempt in (A, R, R.replace("_r_", "_m_")):
        folder = tmp_path / "hostA" / attempt
        folder.mkdir(parents=True)
        (folder / "syslog").write_text(START + "\n")

    def found(*args):
        rows = sources.read_attempt_logs(spark, sources.attempt_glob(str(tmp_path), *args))
        return {r.attempt_id for r in rows.collect()}

    assert found() == {A, R, R.replace("_r_", "_m_")}
    assert found("job_201001052153_0021") == {R, R.replace("_r_", "_m_")}
    assert found("201001052153_0021", "r") == {R}


def test_attempt_facts_use_one_hash_aggregation(spark, capsys):
    attempts.attempt_times(log(spark, [START, DONE])).explain()
    plan = capsys.readouterr().out
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1
