"""Files: types round trip with nulls, options, projection, seek, statistics and footers."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colonnade.functions import bits, rle
from colonnade.operators import scan, statistics
from colonnade.schema import flatten, names_of
from colonnade.sources import footer
from colonnade.sources.files import CODECS, WriterOptions, count_and_bounds, read_orc, write_orc

SCHEMA = "id long, b boolean, y tinyint, s smallint, i int, f float, d double, t string, bin binary, dec decimal(18,2), day date, ts timestamp_ntz, l array<int>, m map<string,int>, st struct<x:int,y:struct<z:string>>"


def rows(n):
    out = []
    for k in range(n):
        null = k % 5 == 4
        out.append((k, *([None] * 14 if null else [k % 3 == 0, k % 256 - 128, -k, k * k, k / 4, -k / 3, f"täxt {k}", bytes([k % 256]), decimal.Decimal(k) / 4, dt.date(1960, 1, 1) + dt.timedelta(k * 100), dt.datetime(1969, 12, 31, 23, 59, 59, 5000) + dt.timedelta(days=k), [k, None, -k][: k % 4], {f"k{k}": k}, (k, (f"z{k}",))])))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(60), SCHEMA)


@pytest.mark.parametrize("codec", CODECS)
def test_all_types_in_all_codecs(spark, df, tmp_path, codec):
    path = write_orc(df, f"file://{tmp_path}/t", WriterOptions(codec=codec))
    assert sorted(read_orc(spark, path).collect()) == sorted(df.collect())


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097])
def test_every_row_comes_back(spark, tmp_path, n):
    path = write_orc(spark.range(n), f"file://{tmp_path}/t")
    got = read_orc(spark, path, "id long")
    assert got.count() == n and [r[0] for r in got.orderBy("id").collect()] == list(range(n))


def test_files_without_a_byte(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "empty.orc").write_bytes(b"")
    assert read_orc(spark, f"file://{tmp_path}/t", "id long").count() == 0
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        read_orc(spark, f"file://{tmp_path}/t")


def test_options_are_checked():
    with pytest.raises(ValueError):
        WriterOptions(codec="brotli")
    with pytest.raises(ValueError):
        WriterOptions(row_index_stride=10)


def test_ids_and_names(df):
    columns = flatten(df.schema)
    assert [c.id for c in columns] == list(range(len(columns)))
    st = next(c for c in columns if c.path == "st")
    assert names_of(df.schema, [0, 1, st.id, st.id + 2, st.id + 3]) == ["id", "st.y.z"]
    assert names_of(df.schema, []) == df.columns
    with pytest.raises(ValueError):
        names_of(df.schema, [0, st.id + 3])
    with pytest.raises(ValueError):
        names_of(df.schema, [0, 99])
    with pytest.raises(ValueError):
        flatten(StructType().add("v", "interval day to second"))


def test_projection_and_predicates_reach_the_scan(spark, df, tmp_path):
    path = write_orc(df, f"file://{tmp_path}/t")
    own = read_orc(spark, path)
    plan = own.where("i >= 100").select("st.y.z")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<i:int,st:struct<y:struct<z:string>>>" in plan
    assert "GreaterThanOrEqual(i,100)" in plan


def test_seek_skip_and_batches(spark, tmp_path):
    path = write_orc(spark.range(2500).withColumnRenamed("id", "row_no"), f"file://{tmp_path}/t", sort_by=["row_no"], files=2)
    own = read_orc(spark, path)
    ids = lambda d: sorted(r[0] for r in d.collect())
    assert ids(scan.seek(own, 2499)) == [2499] and ids(scan.seek(own, 2500)) == []
    assert ids(scan.seek_stride(own, 2, 1000)) == list(range(2000, 2500))
    assert ids(scan.skip(own, 2400)) == list(range(2400, 2500))
    assert ids(scan.read_rows(own, 10, 3)) == [10, 11, 12]
    with pytest.raises(ValueError):
        scan.seek(own, -1)
    sizes = [b.num_rows for b in scan.batches(own, 1000)]
    assert sizes == [1000, 1000, 500]
    with pytest.raises(ValueError):
        next(scan.batches(own, 0))


def test_row_numbers_over_many_partitions(spark):
    own = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = scan.with_row_no(own, ["v"]).collect()
    assert all(r["v"] == r["row_no"] for r in got) and len(got) == 1000


def test_not_null_check(spark):
    own = spark.createDataFrame([(1,), (None,)], "v int")
    with pytest.raises(Exception, match="null in v"):
        scan.check_not_null(own, ["v"]).collect()


def test_statistics(spark):
    own = spark.createDataFrame([(1, -5, "b"), (2, None, None), (3, -9, "aä")], "r int, v long, t string")
    got = statistics.file_stats(own, ["v", "t"]).first().asDict()
    assert got == {"v_n": 2, "v_has_null": True, "v_min": -9, "v_max": -5, "v_sum": -14, "t_n": 2, "t_has_null": True, "t_min": "aä", "t_max": "b", "t_sum": 4}


def test_footers(spark, df, tmp_path):
    path = write_orc(df, f"file://{tmp_path}/t", WriterOptions(codec="zlib", row_index_stride=1000), files=1)
    tail = footer.tails(spark, path).collect()
    assert len(tail) == 1 and tail[0]["n_rows"] == 60 and tail[0]["codec"] == "ZLIB" and tail[0]["row_index_stride"] == 1000
    assert footer.number_of_rows(spark, path) == 60
    assert footer.stripes(spark, path).agg(F.sum("n_rows")).first()[0] == 60
    own = {r["column_id"]: r for r in footer.file_statistics(spark, path).collect()}
    assert (own[5]["n_values"], own[5]["has_null"], own[5]["min"], own[5]["max"]) == (48, True, "0", str(58 * 58))
    assert footer.stripe_statistics(spark, path).count() == len(own)


@pytest.mark.parametrize("codec", CODECS)
def test_footers_equal_the_format_library(spark, df, tmp_path, codec):
    path = write_orc(df.repartition(2), f"file://{tmp_path}/t", WriterOptions(codec=codec, row_index_stride=1000, chunk_size=4096))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = {r["file"]: r for r in footer.tails(spark, path).collect()}
    kept = {(r["file"], r["column_id"]): r for r in footer.file_statistics(spark, path).collect()}
    for f in footer.list_files(spark, path).collect():
        r = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f["path"]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        got = own[f["file"]]
        assert (got["n_rows"], got["content_bytes"], got["codec"], got["row_index_stride"], got["n_stripes"], got["schema"]) == (r.getNumberOfRows(), r.getContentLength(), r.getCompressionKind().toString(), r.getRowIndexStride(), r.getStripes().size(), r.getSchema().toString())
        for k, s in enumerate(r.getStatistics()):
            mine = kept[f["file"], k]
            assert (mine["n_values"], mine["has_null"], mine["bytes_on_disk"]) == (s.getNumberOfValues(), s.hasNull(), s.getBytesOnDisk())
            if s.getClass().getSimpleName().startswith(("Integer", "String")) and s.getNumberOfValues():
                assert (mine["min"], mine["max"]) == (str(s.getMinimum()), str(s.getMaximum()))


def test_row_index_of_files(spark, tmp_path):
    path = write_orc(spark.range(2500), f"file://{tmp_path}/t", WriterOptions(row_index_stride=1000), sort_by=["id"], files=1)
    got = [(r["stride"], r["n_values"], r["min"], r["max"]) for r in footer.row_index(spark, path).where("column_id = 1").orderBy("stride").collect()]
    assert got == [(0, 1000, "0", "999"), (1, 1000, "1000", "1999"), (2, 500, "2000", "2499")]


def test_broken_tails():
    from colonnade.sources.tail import read_tail

    for data in (b"", b"abc", b"x" * 40):
        with pytest.raises((ValueError, IndexError)):
            read_tail(lambda at, n, data=data: data[at : at + n], len(data))


def test_counts_come_from_footers(spark, tmp_path):
    path = write_orc(spark.range(100), f"file://{tmp_path}/t")
    got = count_and_bounds(spark, path, ["id"])
    assert tuple(got.first()) == (100, 0, 99)
    assert "PushedAggregation" in got._jdf.queryExecution().toString()


def test_expressions(spark):
    values = [0, -1, 1, 2147483647, -2147483648, 2**63 - 1, -(2**63)]
    own = spark.createDataFrame([(v,) for v in values], "v long")
    got = own.select("v", bits.zigzag("v").alias("z"), bits.unzigzag(bits.zigzag("v")).alias("u")).collect()
    assert all(r["v"] == r["u"] and r["z"] % 2**64 == rle.zigzag(r["v"]) for r in got)
    hexes = own.select(bits.varint_hex("v", signed=True).alias("h"), "v").collect()
    assert all(bytes.fromhex(r["h"]) == rle.varint(rle.zigzag(r["v"])) for r in hexes)
    nanos = spark.createDataFrame([(n,) for n in (0, 1, 1000, 100000, 688888888, 999999900, 100000000)], "n long")
    got = nanos.select("n", bits.nanos_scaled("n").alias("s"), bits.nanos_plain(bits.nanos_scaled("n")).alias("p")).collect()
    assert all(r["n"] == r["p"] for r in got) and {r["n"]: r["s"] for r in got}[1000] == 0x0A and {r["n"]: r["s"] for r in got}[100000] == 0x0C


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_without_zone_do_not_depend_on_the_session(spark, zone):
    times = [dt.datetime(2024, 7, 1, 12, 30, 59, 999999), dt.datetime(1969, 12, 31, 23, 59, 59, 1), dt.datetime(2015, 1, 1)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        own = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
        got = own.select(bits.timestamp_parts("ts").alias("p")).select("p.*").collect()
        base = dt.datetime(2015, 1, 1)
        assert [(r["secs"], r["nanos"]) for r in got] == [((t - base) // dt.timedelta(seconds=1), t.microsecond * 1000) for t in times]
        assert statistics.file_stats(own, ["ts"]).first()["ts_max"] == 1719837059999
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_runs_across_window_borders(spark):
    n = (1 << 16) * 2 + 50
    own = spark.range(n).select("id", F.when(F.col("id") < 10, 1).when(F.col("id") < n - 5, 2).otherwise(3).alias("v"))
    assert sorted(map(tuple, bits.runs(own, "id", "v", part_rows=1 << 16).collect())) == [(1, 0, 10), (2, 10, n - 15), (3, n - 5, 5)]
    assert bits.runs(own.where("id < 2"), "id", "v").count() == 0


def test_column_encoding_round_trip(spark):
    own = spark.range(1300).select("id", F.expr("nullif(id * id * 7919 - 5000, -5000)").alias("v"))
    blocks = rle.encode_column(own, "id", "v")
    assert blocks.count() == 3
    assert sorted(map(tuple, rle.decode_column(blocks, "id", "v").collect())) == sorted(map(tuple, own.collect()))


def test_stream(spark, tmp_path):
    from colonnade.streaming.orc_stream import append_orc, stream_orc, windowed_stats

    write_orc(spark.range(100).selectExpr("id", "timestamp_seconds(id * 600) as ts", "cast(id as double) as v"), f"file://{tmp_path}/in")
    own = stream_orc(spark, f"file://{tmp_path}/in", "id long, ts timestamp, v double")
    append_orc(own, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(60)
    assert spark.read.orc(f"file://{tmp_path}/out").count() == 100
    windowed = windowed_stats(own, "ts", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    windowed.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 100
