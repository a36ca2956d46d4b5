import itertools

import pytest
from pyspark.sql import functions as F

from runledger.functions.sampling import permuted
from runledger.operators import design
from runledger.sinks import writers
from runledger.sources import specs


def prop(name, n, values, extra=""):
    return (f"<property><name>{name}</name>{extra}<numvalues>{n}</numvalues>"
            f"<values>{values}</values></property>")


def spec(*props):
    return "<?xml version='1.0'?>\n<configuration>\n" + "\n".join(props) + "\n</configuration>\n"


PROGRAM = "<type>HADOOP_JAR</type>"
PIPE = "<value_delimitter>|</value_delimitter>"
FIRST = spec(
    prop("jar_path", 1, "/a.jar", PROGRAM),
    prop("mapred.reduce.tasks", 2, "10,20"),
    prop("input", 3, "/a 1, /b 2,/c 3,"),
    prop("opts", 2, " x | y ", PIPE))
SECOND = spec(prop("io.sort.mb", 4, "1;;2;;;3;;4", "<value_delimitter>;+</value_delimitter>"))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.xml").write_text(FIRST)
    (tmp_path / "b.xml").write_text(SECOND)
    (tmp_path / "README").write_text("not a specification")
    return tmp_path


def test_expansion_of_a_folder(spark, folder):
    rows = design.checked_specs(specs.read_param_specs(spark, str(folder)))
    sizes = {r.file_no: (r.runs, r.params) for r in design.design_size(rows).collect()}
    assert sizes == {0: (12, 4), 1: (4, 1)}
    assert design.design_total(rows).first().runs == 16
    grid = design.expand_design(rows)
    table = {}
    for r in grid.orderBy("run_no", "pos").collect():
        table.setdefault((r.run_no, r.expt_id, r.file_no, r.file_run), []).append(r.value)
    expected = list(itertools.product(
        ["/a.jar"], ["10", "20"], ["/a 1", " /b 2", "/c 3"], [" x ", " y "]))
    assert [tuple(v) for v in table.values()] == expected + [("1",), ("2",), ("3",), ("4",)]
    assert list(table) == [(i, f"EXPT-{i:04d}", int(i >= 12), i - 12 * (i >= 12))
                           for i in range(16)]


def test_blocks_give_the_same_grid(spark, folder, monkeypatch):
    rows = design.checked_specs(specs.read_param_specs(spark, str(folder)))
    whole = sorted(map(tuple, design.expand_design(rows).collect()), key=str)
    monkeypatch.setattr(design, "RUNS_PER_BLOCK", 5)
    assert sorted(map(tuple, design.expand_design(rows).collect()), key=str) == whole


def test_permutation_is_seeded_and_complete(spark, folder):
    rows = design.checked_specs(specs.read_param_specs(spark, str(folder)))
    ids = design.design_ids(design.expand_design(rows))

    def places(seed):
        return {r.expt_id: r.place for r in design.run_order(ids, seed).collect()}

    assert places(None) == {f"EXPT-{i:04d}": i - 12 * (i >= 12) for i in range(16)}
    assert places(7) == places(7) != places(8)
    for seed in (7, 8):
        assert sorted(places(seed).values()) == sorted([*range(12), *range(4)])


def test_places_are_a_permutation_of_every_size(spark):
    """Each of 0 .. n - 1 once, for many n, seeds and groups; no shuffle and no window."""
    sizes = [*range(1, 40), 1000, 10_007]
    cases = spark.createDataFrame([(n, s, g) for n in sizes for s, g in ((0, 0), (42, 5), (-3, -(1 << 62)))], "n long, seed long, g long")
    rows = cases.withColumn("x", F.explode(F.expr("sequence(0, n - 1)"))).withColumn(
        "place", permuted(F.col("x"), F.col("n"), F.col("seed"), F.col("g")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    found = rows.groupBy("n", "seed").agg(F.sort_array(F.collect_list("place")).alias("p"), F.sum((F.col("x") == F.col("place")).cast("int")).alias("fixed")).collect()
    assert len(found) == 3 * len(sizes) and all(r.p == list(range(r.n)) for r in found)
    assert all(r.fixed < 12 for r in found if r.n >= 1000)


@pytest.mark.parametrize("bad, reason", [
    (prop("a", 0, "1"), "above 0"),
    (prop("a", "many", "1"), "above 0"),
    (prop("a", 2, "1"), "does not match"),
    (prop("a", 1, ""), "does not match"),
    (prop("a", 1, "1", "<type>OTHER</type>"), "unsupported type"),
    (prop("jar_owner", 1, "1", PROGRAM), "unsupported program parameter"),
])
def test_violations(spark, bad, reason):
    documents = spark.createDataFrame([(0, "f", spec(bad))], "file_no long, file string, xml string")
    with pytest.raises(ValueError, match=reason):
        design.checked_specs(specs.parse_param_specs(documents))


def test_value_lists(spark):
    rows = [("a,b,,", None), (",a", ""), ("a|b", "|"), ("a1b22c", "[0-9]+"), ("", None),
            (None, None), (",,", None)]
    df = spark.createDataFrame(
        [(v, d, None) for v, d in rows], "values string, value_delimitter string, type string")
    found = [r.value_list for r in design.split_values(df).collect()]
    assert found == [["a", "b"], ["", "a"], ["a", "b"], ["a", "b", "c"], [], [], []]


def test_sinks(spark, folder, tmp_path):
    rows = design.checked_specs(specs.read_param_specs(spark, str(folder)))
    grid = design.expand_design(rows)
    writers.write_design(grid, str(tmp_path / "design"), 3)

    parts = sorted((tmp_path / "design").glob("part-*"))
    blocks = "".join(p.read_text() for p in parts).split("\n\n")
    first, second, rest = (b.splitlines() for b in blocks)
    assert len(parts) > 1 and rest == []
    assert first[0] == "EXPT_ID\tjar_path\tmapred.reduce.tasks\tinput\topts"
    assert first[2] == "EXPT-0001\t/a.jar\t10\t/a 1\t y "
    assert [line.split("\t")[0] for line in first[1:]] == [f"EXPT-{i:04d}" for i in range(12)]
    assert second == ["EXPT_ID\tio.sort.mb", *[f"EXPT-{11 + i:04d}\t{i}" for i in range(1, 5)]]
    writers.write_run_confs(grid, str(tmp_path / "confs"))
    back = specs.read_run_confs(spark, str(tmp_path / "confs"))
    kept = grid.filter("type = 'MAPREDUCE_JOBCONF'").select("expt_id", "param", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kept.collect()))
    documents = specs.conf_properties(writers.run_conf_documents(grid))
    assert sorted(map(tuple, documents.collect())) == sorted(map(tuple, kept.collect()))
    writers.write_run_list(design.run_order(design.design_ids(grid)), str(tmp_path / "list"), 2)
    listed = specs.read_run_list(spark, str(tmp_path / "list"))
    assert listed.count() == 16


def test_wide_union(spark, folder):
    rows = design.checked_specs(specs.read_param_specs(spark, str(folder)))
    grid = design.expand_design(rows)
    parts = [grid.filter(F.col("file_no") == n) for n in (0, 1)]
    wide = {r.expt_id: r.params for r in
            design.wide_design(design.union_designs(*parts)).collect()}
    assert wide["EXPT-0012"] == {"io.sort.mb": "1"}
    assert wide["EXPT-0000"]["opts"] == " x "


def test_outputs_of_runs(spark):
    rows = [("E1", "HADOOP_JAR", "jar_output_prefix", "/out", 1, "false"), ("E1", "HADOOP_JAR", "jar_output_prefix", "/new", 2, None),
            ("E2", "HADOOP_JAR", "jar_output_prefix", "/out", 1, "False"), ("E3", "HADOOP_JAR", "jar_path", "/a.jar", 0, "false"),
            ("E4", "MAPREDUCE_JOBCONF", "jar_output_prefix", "/out", 0, "false")]
    table = spark.createDataFrame(rows, "expt_id string, type string, param string, value string, pos int, delete_on_exit string")
    assert sorted(map(tuple, writers.run_outputs(table).collect())) == [("E1", "/new/E1", True), ("E2", "/out/E2", False)]


@pytest.mark.parametrize("block", [2, 5, 1 << 14])
def test_runs_without_their_parameters_are_those_of_the_grid(spark, block, monkeypatch):
    monkeypatch.setattr(design, "RUNS_PER_BLOCK", block)
    rows = spark.createDataFrame(
        [(f, p, f"n{p}", design.JOB_CONF, [str(v) for v in range(n)], None)
         for f, sizes in {3: (2, 3), 1: (1,), 2: (4, 1, 2), 9: (0, 3)}.items() for p, n in enumerate(sizes)],
        "file_no long, pos int, name string, type string, value_list array<string>, delete_on_exit string")
    runs = design.design_runs(rows)
    ids = design.design_ids(design.expand_design(rows)).select(runs.columns)
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, ids.collect()))
    assert runs.count() == 1 + 8 + 6
