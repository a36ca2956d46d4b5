import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.operators import ordering, reshape


def frame(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.sampled_from("abc")), max_size=40))
def test_ordinal_is_a_bijection_in_key_order(spark, rows):
    found = ordering.with_ordinal(frame(spark, rows), ["k", "v"], partitions=3).collect()
    assert sorted(r.ordinal for r in found) == list(range(1, len(rows) + 1))
    assert [(r.k, r.v) for r in sorted(found, key=lambda r: r.ordinal)] == sorted(rows)


def test_copies_are_kept_and_spread(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES_PER_ROW", 100)
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("k"))
    rest = spark.range(10000).select((F.col("id") % 100).alias("k"))
    result = ordering.total_sort(hot.union(rest), ["k"], 8)
    sizes = [r["count"] for r in result.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 15000 and max(sizes) < 6000
    parts = result.select("k", F.spark_partition_id().alias("p"),
                          F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    assert [r.k for r in parts] == sorted(r.k for r in parts)
    numbered, count = ordering.number_rows(hot.union(rest), ["k"], partitions=8)
    assert count == 15000
    assert numbered.agg(F.countDistinct("ordinal"), F.max("ordinal")).first()[:] == (15000, 15000)


def test_one_key_is_spread_over_ranges(spark):
    rows = spark.range(8000).select(
        F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    result = ordering.total_sort(rows, ["k"], 8, collapse_copies=False)
    hot = result.filter("k = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) >= 3


def test_distinct_rows_take_one_shuffle(spark, capsys):
    ordering.total_sort(frame(spark, [(1, "a")]), ["k"], 4, collapse_copies=False).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan


@pytest.mark.parametrize("width", [1, 3, 100])
def test_running_before(spark, width):
    rows = frame(spark, [(i, str(i % 3)) for i in range(0, 50, 2)])
    found = ordering.running_before(
        rows.withColumn("w", F.col("k") + 1), ordering.chunk_of("k", width), ["k"], "w", "before",
        group=["v"]).collect()
    for r in found:
        assert r.before == sum(i + 1 for i in range(0, r.k, 2) if str(i % 3) == r.v)


def test_empty_input(spark):
    assert ordering.with_ordinal(frame(spark, []), ["k"]).count() == 0


def test_descending_and_offset(spark):
    found = ordering.with_ordinal(
        frame(spark, [(1, "a"), (3, "b"), (2, "c")]), [F.desc("k")], "n", 0, 2).collect()
    assert {r.k: r.n for r in found} == {3: 0, 2: 1, 1: 2}


def test_sort_stats_is_numeric(spark):
    df = frame(spark, [("10", "2"), ("9", "x"), ("9", "11"), ("9", "2")], "a string, b string")
    rows = ordering.sort_stats(df, ["a", "b"]).withColumn("i", F.monotonically_increasing_id())
    assert [(r.a, r.b) for r in rows.orderBy("i").collect()] == [
        ("9", "x"), ("9", "2"), ("9", "11"), ("10", "2")]


def test_merge_needs_equal_counts(spark):
    a = frame(spark, [(1, "a"), (2, "b")])
    b = frame(spark, [("x",), ("y",)], "w string")
    merged = reshape.merge_horizontal([(a, ["k"]), (b, [F.desc("w")])]).orderBy("ordinal")
    assert [tuple(r) for r in merged.collect()] == [(1, 1, "a", "y"), (2, 2, "b", "x")]
    with pytest.raises(ValueError, match="different numbers"):
        reshape.merge_horizontal([(a, ["k"]), (b.filter("w = 'x'"), ["w"])])
    with pytest.raises(ValueError, match="must differ"):
        reshape.merge_horizontal([(a, ["k"]), (a, ["k"])])


def test_unify(spark, tmp_path):
    from runledger.sources.lines import read_artifacts
    for run in ("EXPT-0000", "EXPT-0001", "EXPT-0002"):
        for kind in ("userlogs", "history"):
            (tmp_path / run / kind).mkdir(parents=True)
            (tmp_path / run / kind / "same").write_text(f"{run} {kind}\n")
    runs = frame(spark, [("EXPT-0001", 0), ("EXPT-0000", 1)], "expt_id string, run_order long")
    files = read_artifacts(spark, str(tmp_path), "userlogs")
    both = reshape.unify(files, runs, "userlogs")
    assert sorted(r.line for r in both.collect()) == ["EXPT-0000 userlogs", "EXPT-0001 userlogs"]
    assert reshape.unify_last_wins(both).first().line == "EXPT-0000 userlogs"
    with pytest.raises(ValueError, match="kind"):
        reshape.unify(files, runs, "logs")


def test_profiles(spark):
    jobs = frame(spark, [("EXPT-0000", "job_1"), ("EXPT-0001", "job_2"), ("EXPT-0002", None)],
                 "expt_id string, job_id string")
    profiles = frame(spark, [("profile_job_EXPT-0000.xml", "run"), ("profile_job_1.xml", "no"),
                             ("profile_job_2.xml", "job")], "name string, location string")
    found = {r.expt_id: r.profile for r in reshape.resolve_profiles(jobs, profiles).collect()}
    assert found == {"EXPT-0000": "run", "EXPT-0001": "job", "EXPT-0002": None}
    shared = reshape.resolve_profiles(jobs, profiles, "one.xml").collect()
    assert {r.profile for r in shared} == {"one.xml"}


def test_place_in_the_file_breaks_ties_in_one_shuffle(spark, tmp_path, capsys):
    # One key holds all rows, and most rows are whole-row copies.
    frame(spark, [(1, "same")] * 3000 + [(1, f"v{i}") for i in range(50)]).repartition(3).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    ranged = ordering.total_sort(rows, ["k"], 8, from_files=True)
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3050 and max(sizes) < 1000
    ranged.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan
    found = ordering.with_ordinal(rows, ["v"], "n", from_files=True).collect()
    assert sorted(r.n for r in found) == list(range(1, 3051))
    assert [r.v for r in sorted(found, key=lambda r: r.n)] == sorted(r.v for r in found)


def test_running_total_over_ranges(spark):
    rows = frame(spark, [(i, "x") for i in range(0, 200, 2)]).withColumn("w", F.col("k") + 1)
    found = ordering.running_total(rows, ["k"], "w", "before").collect()
    assert len(found) == 100
    assert all(r.before == sum(i + 1 for i in range(0, r.k, 2)) for r in found)
    assert ordering.running_total(rows.limit(0), ["k"], "w", "before").count() == 0
