"""Footers of tables that take several stripes, row groups and files: queries against their SQL, whatever the layout."""

from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from colonnade.plans import catalogue
from colonnade.sources import footer
from colonnade.sources.files import WriterOptions, write_orc

ORDERS = ["cast(hash(id) & 1048575 as long) as o_custkey", "substr('FOP', cast(id % 3 as int) + 1, 1) as o_orderstatus", "id / 4 as o_totalprice", "timestamp_ntz'1998-01-01' as o_orderdate", "sha2(cast(id as string), 256) as o_orderpriority"]


def compare(spark, name, folder):
    df = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}/*.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    assert sorted(map(tuple, df.select(*(d[0] for d in found.description)).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("key", ["id", "id + id div 7500 * 1000000", "id - id div 7500", "if(id % 4000 = 17, null, id * 3)"], ids=["dense", "gaps", "equal", "null"])
def test_strides_over_several_stripes(spark, tmp_path, monkeypatch, key):
    spark.range(30_000).selectExpr(f"{key} as o_orderkey", *ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(catalogue, "WriterOptions", partial(WriterOptions, stripe_size=65_536, chunk_size=8_192))
    compare(spark, "footer_row_index", tmp_path)


def test_stripes_of_whole_strides(spark, tmp_path):
    path = write_orc(spark.range(0, 30_000, 1, 1).selectExpr("id", *ORDERS), f"file://{tmp_path}/t", WriterOptions(stripe_size=65_536, chunk_size=8_192, row_index_stride=1500, whole_strides=True))
    rows = [r["n_rows"] for r in footer.stripes(spark, path).orderBy("stripe").collect()]
    assert len(rows) > 2 and all(n % 1500 == 0 for n in rows) and spark.conf.get("spark.sql.orc.columnarWriterBatchSize") == "1024"
    groups = footer.strides_by_key(spark, path, "id", "o_custkey", 1500)
    assert groups.count() == 20 and groups.where("n_values <> 1500").count() == 0
    assert "Scan orc" not in groups._jdf.queryExecution().toString()  # the index alone says it


LINES = [f"cast({e} as {t}) as l_{c}" for c, t, e in (("orderkey", "long", "id"), ("partkey", "long", "hash(id)"), ("suppkey", "long", "hash(id, 1)"), ("quantity", "double", "id % 50"))]


def test_no_gaps_at_block_borders(spark, tmp_path, monkeypatch):
    """The 64 KB stripes may be padded up to 3 KB before a block's end; here any stripe is that would cross one."""
    spark.range(40_000).selectExpr(*LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalogue, "_SMALL", replace(catalogue._SMALL, more={"orc.block.size": 300_000, "orc.block.padding.tolerance": 1.0}))
    compare(spark, "footer_stripes", tmp_path)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    ids = spark.range(0, 40_000, 1, 4)
    ids.selectExpr(*LINES).write.parquet(f"{folder}/lineitem.parquet")
    ids.selectExpr("id as o_orderkey", *ORDERS[:-3], "id / 4 as o_totalprice", "unix_seconds(timestamp_seconds(id)) as o_orderdate", ORDERS[-1]).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["stripe_stats", "footer_stats", "footer_stripes", "writer_small_stripe", "footer_schema", "footer_user_metadata"])
def test_no_task_writes_a_whole_table(spark, parts, monkeypatch, name):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    monkeypatch.setattr(catalogue, "_WRITTEN", {})
    try:
        compare(spark, name, parts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (path,) = catalogue._WRITTEN.values()
    assert footer.list_files(spark, path).count() >= 4
