from bisect import bisect_right
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.sampling import uniform, zipf_key, zipf_rank
from runledger.plans import domains
from runledger.sinks import writers
from runledger.sources import generate
from runledger.sources.tables import read_tpch


@pytest.mark.parametrize("sf, files, zipf", [(0, 1, 0), (-1, 1, 0), (10, 4, 0), (1, 1, -1), (1, 1, 5)])
def test_guards(spark, sf, files, zipf):
    with pytest.raises(ValueError):
        generate.gen_tpch(spark, sf, files, zipf)


def test_half_the_scale_is_enough_files():
    generate.check_scale(10, 5, 4)


def test_tables(spark, tmp_path):
    tables = generate.gen_tpch(spark, 0.001, 3, zipf=1.0)
    rows = generate.table_rows(0.001)
    for name, df in tables.items():
        assert [f.name for f in df.schema] == [f.name for f in schemas.TPCH[name]]
        assert df.count() == rows[name]
    assert tables["lineitem"].join(
        tables["orders"], F.col("l_orderkey") == F.col("o_orderkey")).count() == rows["lineitem"]
    for column, table, key in (("l_partkey", "part", "p_partkey"),
                               ("l_suppkey", "supplier", "s_suppkey"),
                               ("ps_suppkey", "supplier", "s_suppkey")):
        source = tables["partsupp" if column.startswith("ps") else "lineitem"]
        assert source.join(tables[table], F.col(column) == F.col(key), "left_anti").count() == 0
    assert tables["partsupp"].dropDuplicates(["ps_partkey", "ps_suppkey"]).count() == rows["partsupp"]
    again = generate.gen_tpch(spark, 0.001, 5, zipf=1.0)
    assert again["orders"].exceptAll(tables["orders"]).count() == 0
    path = str(tmp_path / "tpch")
    writers.write_tables(tables, path, 3, placed=True)
    for name, df in tables.items():
        back = read_tpch(spark, f"{path}/{name}", name)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
        files = len(list((tmp_path / "tpch" / name).glob("part-*")))
        assert files == (1 if name in ("region", "nation") else 3)
    with pytest.raises(Exception, match="already exists"):
        writers.write_tables(tables, path, 3)


def test_sort_records(spark):
    df = generate.gen_sort_records(spark, 1000, 4)
    size = F.octet_length("key") + F.octet_length("rowid") + F.octet_length("filler")
    assert df.agg(F.min(size), F.max(size), F.countDistinct("rowid"),
                  F.countDistinct("key")).first()[:] == (100, 100, 1000, 1000)
    assert df.agg(F.min(F.octet_length("key")), F.max(F.octet_length("key"))).first()[:] == (10, 10)


def test_random_text(spark):
    df = generate.gen_random_text(spark, 200_000, 3, (5, 10), (2, 4))
    sizes = df.select(F.size(F.split("key", " ")).alias("k"), F.size(F.split("value", " ")).alias("v"),
                      (F.octet_length("key") + F.octet_length("value") + 2).alias("b"),
                      F.spark_partition_id().alias("p"))
    assert sizes.agg(F.min("k"), F.max("k"), F.min("v"), F.max("v")).first()[:] == (5, 10, 2, 4)
    for r in sizes.groupBy("p").agg(F.sum("b").alias("b")).collect():
        assert abs(r.b - 200_000) < 10_000


@pytest.mark.parametrize("z", [0, 0.5, 1, 2, 4])
@pytest.mark.parametrize("n", [1, 10, 5000])
def test_zipf_shares(spark, z, n):
    grid = 20000
    u = (F.col("id") + 0.5) / grid
    counts = {r["rank"]: r["count"] for r in
              spark.range(grid).select(zipf_rank(u, n, z).alias("rank")).groupBy("rank").count().collect()}
    total = sum(k ** -z for k in range(1, n + 1))
    assert min(counts) >= 1 and max(counts) <= n
    seen = expected = 0
    for k in range(1, n + 1):
        seen += counts.get(k, 0)
        expected += k ** -z / total * grid
        assert abs(seen - expected) <= 2


@pytest.mark.parametrize("z", [0.5, 1, 1.5, 4])
@pytest.mark.parametrize("n", [64, 65, 3000])
def test_zipf_ranks_follow_the_exact_sums(spark, z, n):
    weights = [k ** -float(z) for k in range(1, n + 1)]
    bounds = [s / sum(weights) for s in accumulate(weights)]
    u = [(i + 0.5) / 5000 for i in range(5000)]
    rows = spark.createDataFrame([(x,) for x in u], "u double").select("u", zipf_rank(F.col("u"), n, z).alias("rank")).collect()
    assert all(r["rank"] == min(bisect_right(bounds, r["u"]) + 1, n) for r in rows)


def test_zipf_key_is_a_function_of_the_row(spark):
    df = spark.range(2000)
    one = zipf_key(df, "id", 100, 1.0, seed=3)
    two = zipf_key(df.repartition(7), "id", 100, 1.0, seed=3)
    assert one.exceptAll(two).count() == 0
    assert one.groupBy("zipf_key").count().filter("zipf_key = 1").first()["count"] > 250


def test_uniform(spark):
    row = spark.range(20000).select(uniform(1, F.col("id")).alias("u")).agg(
        F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.01


def test_run_output(spark, tmp_path):
    df = spark.range(10)
    prefix = str(tmp_path / "out")
    assert writers.write_run(df, prefix, "EXPT-0000") is None
    assert not (tmp_path / "out").exists()
    writers.write_run(df, prefix, "EXPT-0000", keep=True)
    path = writers.write_run(df.filter("id < 3"), prefix, "EXPT-0000", keep=True)
    assert spark.read.parquet(path).count() == 3
    flags = spark.createDataFrame([("false",), ("true",), (None,), ("FALSE",)], "d string")
    assert [r.k for r in flags.select(writers.keeps_output(F.col("d")).alias("k")).collect()] == [
        True, False, False, False]


def test_delimited_text_comes_back_unchanged(spark):
    from runledger.functions.delimited import read_delimited
    from runledger.session import scratch_path
    from runledger.sinks import writers

    texts = [" padded ", "two\nlines", "", None, "tab\there", 'quo"te', "\\N", "\\n", "a|b", "end\\", "\r\n", '"', "\\b\\"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = scratch_path(spark, "delimited")
    writers.write_tsv(rows, f"{path}/tsv")
    writers.write_tables({"t": rows}, path, 2)
    for found in (read_delimited(spark, f"{path}/tsv", rows.schema, "\t"), read_delimited(spark, f"{path}/t", rows.schema, "|")):
        assert [r.text for r in sorted(found.collect())] == texts


@pytest.mark.parametrize("size", [2, 3, 50, 500, generate.TEXT_CHUNK, generate.TEXT_CHUNK + 1, 3 * generate.TEXT_CHUNK + 4095, 200_001])
def test_random_text_has_exactly_the_bytes(spark, size):
    df = generate.gen_random_text(spark, size, 3)
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("key") + F.octet_length("value") + 2).alias("b"))
    assert [r.b for r in sizes.collect()] == [size] * 3
    words = df.select(F.size(F.split("key", " ")).alias("k"), F.size(F.split("value", " ")).alias("v"))
    if size >= 500:
        assert words.agg(F.min("k"), F.max("k"), F.min("v"), F.max("v")).first()[:] == (5, 10, 5, 10)
    assert df.exceptAll(generate.gen_random_text(spark, size, 3)).count() == 0


def test_random_text_of_asked_sizes(spark, monkeypatch):
    monkeypatch.setattr(generate, "TEXT_CHUNK", 5000)
    asked = {"a": 300_000, "b": 2, "c": 0, "d": None, "e": 5001, "é": 9095, "f": 9096}
    sizes = spark.createDataFrame(list(asked.items()), "name string, bytes int")
    text = generate.random_text_like(sizes, "name", "bytes", (2, 3), (1, 1))
    found = {r.name: r.b for r in text.groupBy("name").agg(F.sum(F.octet_length("key") + F.octet_length("value") + 2).alias("b")).collect()}
    assert found == {k: v for k, v in asked.items() if v}
    # Chunks are made apart from each other: no sentence pair stands in all of them.
    assert text.filter("name = 'a'").groupBy("key", "value").count().agg(F.max("count")).first()[0] < 10


def test_columns_keep_to_their_rules(spark):
    rows = generate.table_rows(0.002)
    rules = domains.domains(rows)
    for name, df in generate.gen_tpch(spark, 0.002, 2, zipf=1.0).items():
        checked = domains.check_columns(df, name, rules[name]).collect()
        assert [r.col for r in checked] == df.columns
        assert all(r.n == rows[name] and r.odd == 0 for r in checked), [r for r in checked if r.odd]


def test_values_that_break_a_rule_are_counted(spark):
    rules = domains.domains(generate.table_rows(0.002))["region"]
    df = spark.createDataFrame([(0, "ASIA", "coba diba fego huji"), (9, "ASIA", "coba diba fego"), (None, "Asia", None)],
                               "r_regionkey int, r_name string, r_comment string")
    assert [(r.col, r.odd, r.listed) for r in domains.check_columns(df, "region", rules).collect()] == [
        ("r_regionkey", 2, None), ("r_name", 1, 1), ("r_comment", 2, None)]
    assert [r.odd for r in domains.check_columns(df.limit(0), "region", rules).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        domains.check_columns(df.withColumn("more", F.lit(1)), "region", rules)
