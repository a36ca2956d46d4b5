import pytest
from pyspark.sql import functions as F

from runledger.operators import jobs, joins
from runledger.session import fits_broadcast, row_bytes


@pytest.fixture()
def sides(spark):
    left = spark.range(20).select(F.col("id").alias("a"), F.concat(F.lit("n"), "id").alias("b"))
    right = spark.range(300).select(
        F.col("id").alias("c"),
        F.when(F.col("id") < 100, 3).otherwise(F.col("id") % 40).alias("d"))
    return left, right


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_strategies_agree(sides, capsys):
    left, right = sides
    results = {}
    for strategy in joins.STRATEGIES:
        df = joins.join_by_position(left, 1, right, 2, strategy)
        results[strategy] = sorted(map(tuple, df.collect()))
        assert df.columns == ["a", "b", "c", "d"]
    assert results["merge"] == results["broadcast"] == results["salted"]
    assert len(results["merge"]) > 100
    assert "SortMergeJoin" in plan(joins.join_by_position(left, 1, right, 2), capsys)
    assert "BroadcastHashJoin" in plan(jobs.JOBS["MapJoin"](left, 1, right, 2), capsys)


def test_salted_join_keeps_copies(spark):
    left = spark.range(5).select(F.col("id").alias("a"))
    right = spark.range(900).select((F.col("id") % 3 * 0 + 2).alias("b"))
    assert joins.join_by_position(left, 1, right, 1, "salted").count() == 900


def test_a_side_beyond_the_limit_is_not_broadcast(sides, capsys):
    left, right = sides
    assert not fits_broadcast(left, 100)
    df = joins.join_by_position(left, 1, right, 2, "broadcast", limit=100)
    assert "SortMergeJoin" in plan(df, capsys)


def test_row_bytes_counts_text(spark):
    short = spark.createDataFrame([("x", [1])], "s string, a array<int>")
    long = spark.createDataFrame([("x" * 1000, [1])], "s string, a array<int>")
    assert row_bytes(long) == row_bytes(short) + 999
    assert row_bytes(short.filter("s = 'y'")) == 0


def test_bad_arguments(sides):
    left, right = sides
    with pytest.raises(ValueError, match="column 3"):
        joins.join_by_position(left, 3, right, 1)
    with pytest.raises(ValueError, match="column 0"):
        joins.join_by_position(left, 0, right, 1)
    with pytest.raises(ValueError, match="both sides"):
        joins.join_by_position(left, 1, left, 1)
    with pytest.raises(ValueError, match="strategy"):
        joins.join_by_position(left, 1, right, 1, "other")


def test_word_count(spark):
    lines = spark.createDataFrame([(" a b\tA\n\nb ",), ("",), ("b\x0bc",)], "line string")
    found = {r.word: r.n for r in jobs.JOBS["wordcount"](lines).collect()}
    assert found == {"a": 1, "b": 2, "A": 1, "b\x0bc": 1}


def test_spread_only_when_cores_would_idle(spark):
    from runledger.sources.tables import spread
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    wide = spark.range(10, numPartitions=cores + 3)
    assert spread(wide) is wide


def test_number_of_reducers(spark):
    left = spark.range(50).selectExpr("id as a", "id * 2 as b")
    right = spark.range(200).selectExpr("id % 60 as c", "id as d")
    joined = joins.join_by_position(left, 1, right, 1, n=7)
    plain = joins.join_by_position(left, 1, right, 1)
    assert sorted(joined.collect()) == sorted(plain.collect())
    assert "hashpartitioning(a" in joined._jdf.queryExecution().toString() and ", 7)" in joined._jdf.queryExecution().toString()
    for options in ({"n": 0}, {"n": 3, "strategy": "broadcast"}):
        with pytest.raises(ValueError, match="reducers"):
            joins.join_by_position(left, 1, right, 1, **options)


def test_salted_join_of_hot_and_cold_keys(spark):
    left = spark.createDataFrame([(i, f"n{i % 7}") for i in [*range(40), 3, 3]] + [(None, "null")], "a int, b string")
    right = spark.createDataFrame([(3, i % 5) for i in range(400)] + [(i, i) for i in range(60)] + [(None, 1)] * 90, "c int, d int")
    assert 3 in joins.hot_keys(right, "c", 16)
    both = [sorted(map(tuple, joins.join_by_position(left, 1, right, 1, s).collect())) for s in ("merge", "salted")]
    assert both[0] == both[1] and len(both[0]) == 3 * 401 + 39
    assert joins.hot_keys(right.filter("c is null"), "c", 16) == []
    assert joins.join_by_position(left, 1, right.limit(0), 1, "salted").count() == 0


@pytest.mark.parametrize("salts", [2, 16, 64])
def test_sketched_keys_hold_all_hot_ones(spark, salts):
    """Many keys just above and just below the bound, among very many rare ones, over several tasks."""
    n = 40_000
    heavy = [(f"h{k}",) for k in range(salts - 1) for _ in range(n // salts + 1)][:n * 9 // 10]
    rare = [(f"r{i}",) for i in range(n - len(heavy))]
    rows = spark.createDataFrame(heavy + rare, "k string").repartition(7)
    counts = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    hot = {k for k, c in counts.items() if c * salts > n}
    found = joins.hot_keys(rows, "k", salts)
    assert hot <= set(found) and len(found) <= 4 * salts and hot


def test_salted_join_scans(spark):
    """The right side is read three times: for the sketch, the cold and the hot keys."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    right = spark.createDataFrame([(3, i) for i in range(400)] + [(i, i) for i in range(60)], "c int, d int").mapInArrow(counted, "c int, d int")
    left = spark.createDataFrame([(i, "x") for i in range(60)], "a int, b string")
    assert joins.join_by_position(left, 1, right, 1, "salted").count() == 460
    assert seen.value <= 3 * 460


def test_packed_artifacts(spark, tmp_path):
    from runledger.operators import reshape
    from runledger.sinks import writers
    from runledger.sources.lines import read_packed

    rows = [(f"EXPT-{run:04d}", kind, f"f{run % 3}", line, f"{run} {kind} {line}")
            for run in range(600) for kind in ("userlogs", "history") for line in range(2 + 500 * (run == 7))]
    lines = spark.createDataFrame(rows, "expt_id string, kind string, file_name string, line_no long, line string")
    path = str(tmp_path / "packed")
    writers.pack_artifacts(lines, path, 4)
    # 1,200 artifacts are in a few files; a kind that is not there has none.
    assert len(list((tmp_path / "packed").rglob("part-*.parquet"))) <= 8
    back = read_packed(spark, path, "userlogs")
    wanted = lines.filter("kind = 'userlogs'")
    assert back.select(lines.columns).exceptAll(wanted).count() == 0 and back.count() == wanted.count()
    assert read_packed(spark, path, "profiles").count() == 0
    some = read_packed(spark, path, "history", ["EXPT-0007", "EXPT-0500", "EXPT-9999"])
    assert some.count() == 504
    assert read_packed(spark, path, "history", []).count() == 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "GreaterThanOrEqual(expt_id,EXPT-0007)" in plan
    runs = spark.createDataFrame([("EXPT-0007", 1), ("EXPT-0010", 2), ("EXPT-0007", 3), ("EXPT-0008", 4)], "expt_id string, run_order long")
    last = reshape.unify_lines_last_wins(reshape.unify(back, runs, "userlogs")).collect()
    assert {(r.file_name, r.expt_id) for r in last} == {("f1", "EXPT-0007"), ("f2", "EXPT-0008")}
    assert len(last) == 504
