import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger.session import scratch_path
from runledger.sinks import containers, writers


def plain_vint(n):
    if n <= 127:
        return bytes([n])
    size = (n.bit_length() + 7) // 8
    return bytes([144 - size]) + n.to_bytes(size, "big")


def test_lengths_are_written_as_in_plain_loops():
    numbers = [0, 1, 127, 128, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**31 - 1]
    content, sizes = containers.vints(numbers)
    assert content.tobytes() == b"".join(map(plain_vint, numbers))
    assert list(sizes) == [len(plain_vint(n)) for n in numbers]


def test_values_are_laid_out_as_in_plain_loops():
    texts = ["", "a", "é" * 100, "x" * 300, ""]
    column = pa.array(["cut", *texts]).slice(1)
    content, sizes = containers.serialized(column)
    plain = [plain_vint(len(t.encode())) + t.encode() for t in texts]
    assert content.tobytes() == b"".join(plain) and list(sizes) == list(map(len, plain))
    content, sizes = containers.serialized(pa.array([1, -2], pa.int64()))
    assert content.tobytes() == (1).to_bytes(8, "big") + (-2).to_bytes(8, "big", signed=True)
    content, _ = containers.serialized(pa.array([b"", b"ab"], pa.binary()))
    assert content.tobytes() == bytes(4) + b"\0\0\0\2ab"
    with pytest.raises(ValueError, match="null"):
        containers.serialized(pa.array(["a", None]))


def test_blocks_hold_all_rows(monkeypatch):
    monkeypatch.setattr(containers, "BLOCK_BYTES", 40)
    batch = pa.record_batch([pa.array(range(9), pa.int64()), pa.array(["x" * n for n in (0, 50, 3, 90, 1, 1, 1, 30, 2)])], ["k", "v"])
    pieces = list(containers._pieces(batch))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
    for piece in pieces:
        assert len(piece) == 1 or sum(8 + len(v) for v in piece.column(1).to_pylist()) <= 40


@pytest.mark.parametrize("key, value, schema", [
    ("id", "cast(id as string)", "k long, v string"), ("cast(id as int)", "id / 3", "k int, v double"),
    ("concat('k', id)", "repeat('é\\n', cast(id as int))", "k string, v string")])
def test_other_readers_get_the_same_rows(spark, key, value, schema):
    rows = spark.range(0, 500, numPartitions=5).filter("id < 100 or id > 300").selectExpr(f"{key} as k", f"{value} as v")
    path = scratch_path(spark, "sequence")
    writers.write_sequence(rows, "k", "v", path)
    back = writers.read_sequence(spark, path, schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(os.listdir(path)) == ["_SUCCESS", *[f"part-{n:05d}" for n in (0, 3, 4)]]
    with pytest.raises(ValueError, match="exists"):
        writers.write_sequence(rows, "k", "v", path)


def test_no_rows_and_binary_values(spark):
    path = scratch_path(spark, "sequence")
    writers.write_sequence(spark.range(0).selectExpr("id", "'x' as v"), "id", "v", path)
    assert os.listdir(path) == ["_SUCCESS"]
    path = scratch_path(spark, "sequence")
    writers.write_sequence(spark.range(3).selectExpr("id", "cast('ab' as binary) as v"), "id", "v", path)
    assert sorted(spark.sparkContext.sequenceFile(path).mapValues(bytes).collect()) == [(n, b"ab") for n in range(3)]


def test_a_failed_job_leaves_no_file(spark):
    path = scratch_path(spark, "sequence")
    # The last partition fails after the others have written.
    rows = spark.range(0, 100, numPartitions=4).select(
        "id", F.when(F.col("id") == 99, F.raise_error("stop")).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception):
        writers.write_sequence(rows, "id", "v", path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_an_attempt_that_is_not_committed_is_never_seen(spark, tmp_path):
    writer = containers.SequenceWriter(None, str(tmp_path), writers.SEQUENCE_CODEC, False)
    staging = tmp_path / containers.STAGING / writer.job
    staging.mkdir(parents=True)
    (staging / "lost").write_bytes(b"half")
    (staging / "whole").write_bytes(b"all")
    writer.commit([containers.Written(str(staging / "whole"), "part-00000"), containers.Written("", "part-00001")])
    assert sorted(os.listdir(tmp_path)) == ["_SUCCESS", "part-00000"]
    assert (tmp_path / "part-00000").read_bytes() == b"all"
