"""Streams of bytes both ways, compressed chunks of every codec, run lengths over many blocks, cursors by row numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.api import Reader
from colonnade.functions import bits, rle, streams
from colonnade.operators import scan
from colonnade.sources import footer
from colonnade.sources.files import CODECS, WriterOptions, read_orc, write_orc


@pytest.mark.parametrize("kind, code", [("float", "<f4"), ("double", "<f8")])
def test_floats_and_their_bytes(spark, kind, code):
    lists = [[0.0, -0.0, 1.5, -2.25, 3.4e38 if kind == "float" else 1e300], [], None, [float("inf"), float("-inf"), 1e-45 if kind == "float" else 5e-324]]
    df = spark.createDataFrame([(k, x, "c0") for k, x in enumerate(lists)], f"i int, x array<{kind}>, c1 string")
    coded = streams.float_bytes(df, "x", kind)
    assert coded.columns == df.columns
    got = {r["i"]: r["x"] for r in coded.collect()}
    for i, x in enumerate(lists):
        assert got[i] is None if x is None else bytes(got[i]) == np.array(x, code).tobytes()
    assert [r["x"] for r in streams.bytes_floats(coded, "x", kind).orderBy("i").collect()] == [r["x"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("signed", [False, True])
def test_varints_both_ways(spark, signed):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62, 2**63 - 1] + ([-1, -64, -65, -(2**63)] if signed else [])
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", bits.varint_hex("v", signed).alias("h")).select("v", "h", bits.varint_value("h", signed).alias("w")).collect()
    for r in rows:
        assert r["w"] == r["v"]
        assert bytes.fromhex(r["h"]) == rle.varint(rle.zigzag(r["v"]) if signed else r["v"])


def test_run_lengths_of_bytes_and_bits(spark):
    rng = np.random.default_rng(2)
    runs = [np.repeat(rng.integers(-128, 128, 9), rng.integers(1, 200, 9)).tolist() for _ in range(5)] + [[]]
    df = spark.createDataFrame([(k, bytearray(rle.encode_bytes(bytes(x & 255 for x in v)))) for k, v in enumerate(runs)] + [(9, None)], "k int, v binary")
    assert [r["v"] for r in streams.run_lengths_bytes(df, "v").orderBy("k").collect()] == [*runs, None]
    flags = [bool(x) for x in rng.integers(0, 2, 800)]
    df = spark.createDataFrame([(bytearray(rle.encode_bools(flags)),)], "v binary")
    assert streams.run_lengths_bools(df, "v").first()["v"] == flags


@pytest.mark.parametrize("codec", CODECS)
def test_footers_of_every_codec(spark, tmp_path, codec):
    """Long repetitive names make footers and statistics that codecs shrink."""
    names = [f"a_long_column_name_that_repeats_itself_{'again_' * (k % 5)}{k}" for k in range(60)]
    df = spark.range(3000).select(*((F.col("id") * (k + 1)).alias(n) for k, n in enumerate(names)))
    path = write_orc(df, f"file://{tmp_path}/t", WriterOptions(codec=codec, stripe_size=65_536, chunk_size=16_384), files=1)
    [tail] = footer.tails(spark, path).collect()
    assert tail["n_rows"] == 3000 and tail["codec"] == codec.upper() and all(f"{n}:bigint" in tail["schema"] for n in names)
    got = {r["column_id"]: r for r in footer.file_statistics(spark, path).collect()}
    assert all((got[k + 1]["min"], got[k + 1]["max"]) == ("0", str(2999 * (k + 1))) for k in range(60))


@pytest.mark.parametrize("block", [7, 512])
def test_blocks_over_many_batches(spark, block):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(2011).select("id", F.expr("if(id % 5 = 0, null, (id * 7919 % 1000) * 4611686018427387)").alias("v")).repartition(5)
        coded = rle.encode_column(df, "id", "v", block)
        assert coded.count() == -(-2011 // block) == coded.select("block_no").distinct().count()
        assert sorted(map(tuple, rle.decode_column(coded, "id", "v").collect())) == sorted(map(tuple, df.collect()))
        assert rle.decode_column(rle.encode_column(df.limit(0), "id", "v"), "id", "v").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cursor_windows_are_not_sorted_by_spark(spark, tmp_path, monkeypatch):
    from colonnade import api

    monkeypatch.setattr(api, "WINDOW_ROWS", 250)
    path = write_orc(spark.range(1000).select("id", (F.col("id") * 2).alias("x"), F.col("id").alias("row_no")), f"file://{tmp_path}/t", files=4, sort_by=["row_no"])
    cursor = Reader(spark, path).batches(ids=[0, 2], size=100, row_no="row_no")
    plan = cursor._window(500, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "PushedFilters: [IsNotNull(row_no), GreaterThanOrEqual(row_no,500)" in plan
    cursor.seek(455)
    found = list(cursor)
    assert [b.num_rows for b in found] == [100, 100, 100, 100, 100, 45] and found[0].schema.names == ["x"]
    assert [v for b in found for v in b.column(0).to_pylist()] == [2 * k for k in range(455, 1000)]


def test_row_numbers_beside_odd_names(spark):
    df = spark.createDataFrame([(3, 1, "a"), (1, 2, "b"), (2, 3, "c")], "part int, at int, `base.x` string")
    assert sorted(tuple(r) for r in scan.with_row_no(df, ["part"]).collect()) == [(1, 2, "b", 0), (2, 3, "c", 1), (3, 1, "a", 2)]
    assert read_orc and footer
