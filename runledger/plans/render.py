"""Raw text as the parsers expect it, made from the columns of the given tables.

Every line is a function of one table row, so the operators work on as much
text as the tables hold, and the same answer can be had from the columns alone.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger.functions.text import run_id

JOB_STAMP = "202401010000"
LINES_PER_ATTEMPT = 12
REPORT_LINES = 8
CPU_HEADER = "avg-cpu:  %user   %nice %system %iowait  %steal   %idle"
DISK_HEADER = "Device:            tps    MB_read/s    MB_wrtn/s    MB_read    MB_wrtn"
SWAP_HEADER = "procs -----------memory---------- ---swap-- -----io---- --system-- -----cpu------"
SIZE_HEADER = " r  b   swpd   free   buff  cache   si   so    bi    bo   in   cs us sy id wa st"


def job_name(number):
    return F.format_string(f"job_{JOB_STAMP}_%04d", number)


def _attempts(events):
    group = F.floor(F.col("event_id") / LINES_PER_ATTEMPT)
    phase = F.when(group % 3 == 0, "r").otherwise("m")
    return events.select(
        "event_id", "ts", "event_type", "value", group.alias("g"),
        F.format_string("node-%d", group % 7).alias("host"),
        F.format_string(f"attempt_{JOB_STAMP}_%04d_%s_%06d_0", group % 10, phase, group
                        ).alias("attempt_id"))


def _syslog(rows, message):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    return rows.select("host", "attempt_id", F.col("event_id").alias("line_no"),
                       F.concat_ws(" ", stamp, F.lit("INFO"), message).alias("line"))


def attempt_lines(events, ranked_spills=False):
    """Twelve log lines per attempt, a third of the attempts are reduces.

    With ranked_spills the spill numbers count up from 0 in every attempt, but
    for every eleventh event, whose number is 5 too high.
    """
    rows = _attempts(events)
    kind = F.col("event_type")
    number = F.lit(0)
    if ranked_spills:
        order = Window.partitionBy("g").orderBy("event_id").rowsBetween(
            Window.unboundedPreceding, -1)
        rows = rows.withColumn("rank", F.count_if(kind == "click").over(order))
        number = F.col("rank") + F.when(F.col("event_id") % 11 == 0, 5).otherwise(0)
    attempt = F.col("attempt_id")
    message = (
        F.when(kind == "click", F.concat(F.lit("mapred.MapTask: Finished spill "), number))
        .when(kind == "purchase", F.concat(
            F.lit("mapred.TaskRunner: Task:"), attempt,
            F.lit(" is done. And is in the process of commiting")))
        .when(kind == "signup", F.concat(
            F.lit("mapred.TaskRunner: Task '"), attempt, F.lit("' done.")))
        .when(kind == "view", F.concat(
            F.lit("mapred.FileOutputCommitter: Saved output of task '"), attempt,
            F.lit("' to /out")))
        .when(F.col("value") < 10,
              "metrics.jvm.JvmMetrics: Initializing JVM Metrics with processName=CLEANUP")
        .otherwise("mapred.MapTask: Starting flush of map output"))
    return _syslog(rows, message)


def transfer_lines(events):
    kind = F.col("event_type")
    message = (F.when(kind == "view", "mapred.ReduceTask: Shuffling 1024 bytes into RAM")
               .when(kind == "error", "mapred.ReduceTask: Failed to fetch map output")
               .otherwise("mapred.ReduceTask: waiting"))
    return _syslog(_attempts(events), message)


def attempt_files(events):
    rows = _attempts(events)
    return rows.groupBy("host", "attempt_id").agg(F.max("ts").alias("modified"))


def client_lines(events, runs=None):
    """Client output: a user is a run with three jobs; a click starts, a purchase ends.

    With a number of runs, users share them.
    """
    run = F.col("user_id") % runs if runs else F.col("user_id")
    job = job_name(run * 10 + F.col("event_id") % 3)
    kind = F.col("event_type")
    message = (F.when(kind == "click", F.concat(F.lit("Running job: "), job))
               .when(kind == "purchase", F.concat(F.lit("Job complete: "), job))
               .when(kind == "view", " map 100% reduce 0%").otherwise("Counters: 18"))
    stamp = F.date_format("ts", "yy/MM/dd HH:mm:ss")
    return events.select(
        run_id(run).alias("expt_id"), F.col("event_id").alias("line_no"),
        F.concat(stamp, F.lit(" INFO mapred.JobClient: "), message).alias("line"))


def runs_of(events):
    """The runs of all users and one run beyond each tenth that never started."""
    users = events.select("user_id").distinct()
    idle = users.filter(F.col("user_id") % 10 == 0).select(
        (F.col("user_id") + 1_000_000).alias("user_id"))
    return users.union(idle).select(
        run_id(F.col("user_id")).alias("expt_id"), F.col("user_id").alias("run_order"))


def started_runs(events):
    """The runs that started a job, in run order."""
    users = events.filter(F.col("event_type") == "click").select("user_id").distinct()
    return users.select(run_id(F.col("user_id")).alias("expt_id"),
                        F.col("user_id").alias("run_order"))


def _host(events):
    return F.format_string("node-%d", F.col("user_id") % 8)


def _captures(events, prefix, lines, timed):
    rows = events.select(
        _host(events).alias("host"),
        F.concat(F.lit(prefix), _host(events)).alias("capture"),
        F.unix_timestamp("ts").alias("second"), "event_id", F.posexplode(lines).alias("pos", "line"))
    line = F.concat_ws(" ", F.col("second").cast("string"), "line") if timed else F.col("line")
    return rows.filter(F.col("line").isNotNull()).select(
        "host", "capture", (F.col("event_id") * REPORT_LINES + F.col("pos")).alias("line_no"),
        line.alias("line"))


def iostat_lines(events, timed=False):
    """A CPU and a disk report per event; errors cut the CPU line short, and every
    thirteenth report has its CPU header twice."""
    value = F.col("value")
    cpu = F.concat_ws("   ", F.lit(" "), value, F.lit("0.1"), value / 2, F.lit("1.5"),
                      F.lit("0.0"), 100 - value)
    lines = F.array(
        F.when(F.col("event_id") % 13 == 0, CPU_HEADER), F.lit(CPU_HEADER),
        F.when(F.col("event_type") == "error", "1.0 2.0").otherwise(cpu), F.lit(""),
        F.lit(DISK_HEADER), F.lit("sda1 1.0 0.0 0.0 0 0"),
        F.concat_ws(" ", F.lit("sda2 12.00"), value, value * 2, F.lit("32 40")))
    return _captures(events, "iostat_output-", lines, timed)


def vmstat_lines(events, timed=False):
    """A memory line per event, with headers and blank lines in between."""
    lines = F.array(
        F.when(F.col("event_id") % 20 == 0, SWAP_HEADER),
        F.when(F.col("event_id") % 20 == 0, SIZE_HEADER),
        F.when(F.col("event_id") % 50 == 0, ""),
        F.concat_ws(" ", F.lit(" 1  0"), "event_id", F.col("user_id") + 1000,
                    F.floor(F.col("value") * 4), F.length("props"), F.lit("0 0 1 2 3 4")))
    return _captures(events, "vmstat_output-", lines, timed)


def spec_documents(table, key):
    """A specification document per row of a table: 2 to 12 runs over five parameters."""
    s = F.col(key)

    def prop(name, n, values, extra=""):
        return F.concat(F.lit(f"<property><name>{name}</name>{extra}<numvalues>"), n,
                        F.lit("</numvalues><values>"), values, F.lit("</values></property>"))

    program = "<type>HADOOP_JAR</type>"
    tasks = F.array_join(F.transform(
        F.sequence(F.lit(1).cast("long"), 1 + s % 3), lambda i: (i * 10 + s).cast("string")), ",")
    trailing = F.when(s % 5 == 0, ",").otherwise("")
    xml = F.concat(
        F.lit("<configuration>"),
        prop("jar_path", F.lit("1"), F.lit("/jars/job.jar"), program),
        prop("jar_output_prefix", F.lit("1"), F.concat(F.lit("/out/"), s),
             program + "<delete_on_exit>false</delete_on_exit>"),
        prop("mapred.reduce.tasks", 1 + s % 3, F.concat(tasks, trailing)),
        prop("io.sort.mb", 1 + s % 2, F.when(s % 2 == 0, " 100 ").otherwise(" 100 | 200 "),
             "<value_delimitter>|</value_delimitter>"),
        prop("mapred.child.java.opts", F.lit("2"),
             F.concat(F.lit("-Xmx"), s + 200, F.lit("m -server;-Xmx"), s + 400, F.lit("m")),
             "<type>MAPREDUCE_JOBCONF</type><value_delimitter>;</value_delimitter>"),
        F.lit("</configuration>"))
    return table.select(s.alias("file_no"), F.concat(F.lit("spec-"), s).alias("file"),
                        xml.alias("xml"))


def wiki_pages(pages):
    """Pages as wiki mark-up: links to two other pages among templates, tables, references and captions, three deep."""
    number = F.col("page_id")
    text = F.concat(
        F.lit("'''Page "), number, F.lit("''' {{box|x {{in|{{deep|"), number, F.lit("}} y}} z}} see [[Page "),
        number + 1, F.lit("|the {{x|[[y]]}}next]]<ref name=\"a/b\">in {{y|{| z |}}}</ref> and [[Page "), number % 10,
        F.lit("]].\n[[File:a.jpg|thumb|A [[Page "), number + 1, F.lit("|caption [[Page "), number % 10,
        F.lit("]]]] of it]]\n== Source ==\n{| a {| b {{c}} |} [[Page "), number % 10, F.lit("]] |}"), F.col("url"),
        F.lit("<ref name='c>d'/> }} {{ end"))
    return pages.select("page_id", F.col("url").alias("title"), text.alias("text"))


def conf_documents(table, key, name):
    """A job configuration document per row, with its file name."""
    conf = F.concat(F.lit("localhost_1_"), job_name(F.col(key)), F.lit("_conf.xml"))
    xml = F.concat(F.lit("<configuration><property><name>owner</name><value>"), F.col(name),
                   F.lit("</value></property></configuration>"))
    return table.select(conf.alias("conf"), xml.alias("xml"))


def artifacts(events):
    """Files that runs left behind: up to seven per run and kind, the value is the content."""
    kind = (F.when(F.col("event_type").isin("click", "error"), "userlogs")
            .when(F.col("event_type") == "view", "history")
            .when(F.col("event_type") == "purchase", "profiles").otherwise("transfers"))
    rows = events.groupBy("user_id", kind.alias("kind"), (F.col("event_id") % 7).alias("slot")).agg(
        F.max("value").alias("content"))
    return rows.select(
        run_id(F.col("user_id")).alias("expt_id"), "kind",
        F.concat_ws("_", "kind", "slot").alias("file_name"), "content")
