"""Every operator of the library as a query over the test tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import bits, rle, streams
from ..operators import scan, statistics
from ..schema import schema_table
from ..sources import footer
from ..sources.files import CODECS, WriterOptions, count_and_bounds, read_orc, write_orc
from ..store import new_path, ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WRITTEN: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def orc_path(spark: SparkSession, sf_dir: str, name: str, options: WriterOptions = WriterOptions(), make=None, **how) -> str:
    """A table as ORC files, written once a session for each set of options."""
    key = (spark.sparkContext.applicationId, sf_dir, name, repr(options), make, repr(how))
    if key not in _WRITTEN:
        df = table(spark, sf_dir, name)
        _WRITTEN[key] = write_orc(make(df) if make else df, new_path(spark, f"orc-{name}"), options, **how)
    return _WRITTEN[key]


def orc(spark: SparkSession, sf_dir: str, name: str, *args, **kwargs) -> DataFrame:
    return read_orc(spark, orc_path(spark, sf_dir, name, *args, **kwargs))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Scans -------------------------------------------------------------------------------------------

for _name in ("orders", "lineitem", "events", "customer", "part", "supplier", "nation", "region"):
    query(f"scan_{_name}", f"select * from {_name}")(lambda spark, d, n=_name: orc(spark, d, n))


@query("scan_batches_10k", "select event_id // 10000 as batch, count(*) as n, min(value) as low, max(value) as high from events group by 1")
def scan_batches_10k(spark, d):
    return orc(spark, d, "events").groupBy(scan.batch_no("event_id", 10_000).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("scan_batches_100", "select event_id // 100 as batch, count(*) as n, min(value) as low, max(value) as high from events group by 1")
def scan_batches_100(spark, d):
    return orc(spark, d, "events").groupBy(scan.batch_no("event_id", 100).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("scan_count", "select count(*) as n from lineitem")
def scan_count(spark, d):
    return orc(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("scan_count_bounds", "select count(*) as n_rows, min(o_orderkey) as min_o_orderkey, max(o_orderkey) as max_o_orderkey, min(o_custkey) as min_o_custkey, max(o_custkey) as max_o_custkey from orders")
def scan_count_bounds(spark, d):
    return count_and_bounds(spark, orc_path(spark, d, "orders"), ["o_orderkey", "o_custkey"])


@query("scan_filter_pushed", "select o_orderkey, o_totalprice from orders where o_custkey between 100 and 200 and o_orderstatus = 'F'")
def scan_filter_pushed(spark, d):
    return orc(spark, d, "orders").where("o_custkey between 100 and 200 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("scan_empty", "select o_orderkey, o_orderstatus from orders where false")
def scan_empty(spark, d):
    return orc(spark, d, "orders", make=_none_of).select("o_orderkey", "o_orderstatus")


def _none_of(df):
    return df.where("false")


@query("scan_one_row", "select * from orders where o_orderkey = 0")
def scan_one_row(spark, d):
    return orc(spark, d, "orders", make=_one_of)


def _one_of(df):
    return df.where("o_orderkey = 0")


@query("row_numbers", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as row_no from orders")
def row_numbers(spark, d):
    return scan.with_row_no(orc(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_no")


# Sinks -------------------------------------------------------------------------------------------

for _name in CODECS:
    query(f"codec_{_name}", "select * from orders")(lambda spark, d, c=_name: orc(spark, d, "orders", WriterOptions(codec=c)))
query("writer_small_stripe", "select * from orders")(lambda spark, d: orc(spark, d, "orders", WriterOptions(stripe_size=65_536, chunk_size=16_384)))
query("writer_stride", "select * from orders")(lambda spark, d: orc(spark, d, "orders", WriterOptions(row_index_stride=1_000)))
query("writer_no_index", "select * from orders")(lambda spark, d: orc(spark, d, "orders", WriterOptions(create_index=False)))
query("writer_bloom", "select o_orderkey, o_totalprice from orders where o_custkey = 77")(lambda spark, d: orc(spark, d, "orders", WriterOptions(bloom_columns=("o_custkey",))).where("o_custkey = 77").select("o_orderkey", "o_totalprice"))
query("writer_partitioned", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O'")(lambda spark, d: orc(spark, d, "orders", partition_by=["o_orderstatus"]).where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus"))
query("writer_not_null", "select o_orderkey, o_custkey from orders")(lambda spark, d: scan.check_not_null(orc(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"]))

# Projection and seek -------------------------------------------------------------------------------


def _nested_customer(df):
    return df.selectExpr("c_custkey", "named_struct('name', c_name, 'at', named_struct('nation', c_nationkey, 'segment', c_mktsegment)) as st", "c_acctbal")


query("project_ids", "select o_orderkey, o_totalprice, o_orderpriority from orders")(lambda spark, d: scan.project_ids(orc(spark, d, "orders"), [0, 1, 4, 6]))
query("project_all", "select * from orders")(lambda spark, d: scan.project_ids(orc(spark, d, "orders"), []))
query("project_nested", "select c_custkey, c_mktsegment as st_at_segment from customer")(lambda spark, d: scan.project_ids(orc(spark, d, "customer", make=_nested_customer), [0, 1, 2, 4, 6]))
query("schema_flat", """select * from (values (0, '', 'struct', null::int), (1, 'c_custkey', 'long', 0), (2, 'st', 'struct', 0), (3, 'st.name', 'string', 2), (4, 'st.at', 'struct', 2),
  (5, 'st.at.nation', 'int', 4), (6, 'st.at.segment', 'string', 4), (7, 'c_acctbal', 'double', 0)) t(column_id, path, kind, parent_id)""")(lambda spark, d: schema_table(spark, orc(spark, d, "customer", make=_nested_customer).schema))  # fmt: skip
_SORTED = {"sort_by": ["o_orderkey"], "files": 4}
query("seek_row", "select o_orderkey, o_custkey from orders where o_orderkey >= 1500")(lambda spark, d: scan.seek(orc(spark, d, "orders", **_SORTED), 1500, "o_orderkey").select("o_orderkey", "o_custkey"))
query("seek_stride", "select o_orderkey, o_custkey from orders where o_orderkey >= 3000")(lambda spark, d: scan.seek_stride(orc(spark, d, "orders", WriterOptions(row_index_stride=1000), **_SORTED), 3, 1000, "o_orderkey").select("o_orderkey", "o_custkey"))
query("skip_rows", "select o_orderkey from orders where o_orderkey < 200 or o_orderkey >= 300")(lambda spark, d: scan.skip(orc(spark, d, "orders", **_SORTED), 100, "o_orderkey", 200).select("o_orderkey"))
query("read_rows", "select o_orderkey, o_custkey from orders where o_orderkey between 512 and 1023")(lambda spark, d: scan.read_rows(orc(spark, d, "orders", **_SORTED), 512, 512, "o_orderkey").select("o_orderkey", "o_custkey"))
query("seek_past_end", "select o_orderkey from orders where o_orderkey >= 1000000000")(lambda spark, d: scan.seek(orc(spark, d, "orders", **_SORTED), 1_000_000_000, "o_orderkey").select("o_orderkey"))
query("row_position", "select o_orderkey, o_orderkey // 1000 as stride, o_orderkey % 1000 as row_offset from orders")(lambda spark, d: orc(spark, d, "orders").select("o_orderkey", scan.row_position("o_orderkey", 1000).alias("p")).select("o_orderkey", F.col("p.stride").alias("stride"), F.col("p.offset").alias("row_offset")))

# Types: written as the type, read back ---------------------------------------------------------------

_TYPES = {
    "bool": ("orders", ["o_orderkey", "nullif(o_orderstatus, 'P') = 'F' as v"], "select o_orderkey, nullif(o_orderstatus, 'P') = 'F' as v from orders"),
    "byte": ("orders", ["o_orderkey", "cast(nullif(o_orderkey % 256 - 128, 0) as tinyint) as v"], "select o_orderkey, nullif(o_orderkey % 256 - 128, 0)::tinyint as v from orders"),
    "short": ("orders", ["o_orderkey", "cast(nullif(o_custkey % 30000, 7) as smallint) as v"], "select o_orderkey, nullif(o_custkey % 30000, 7)::smallint as v from orders"),
    "int": ("orders", ["o_orderkey", "cast(nullif(o_custkey - 700, 7) as int) as v"], "select o_orderkey, nullif(o_custkey - 700, 7)::int as v from orders"),
    "long": ("orders", ["o_orderkey", "nullif(o_custkey * 4611686018427 - 7, 1) as v"], "select o_orderkey, nullif(o_custkey * 4611686018427 - 7, 1)::bigint as v from orders"),
    "float": ("embeddings", ["vec_id", "embedding[0] as v"], "select vec_id, embedding[1] as v from embeddings"),
    "double": ("events", ["event_id", "nullif(value, 0) as v"], "select event_id, nullif(value, 0) as v from events"),
    "string": ("documents", ["doc_id", "nullif(text, '') as v"], "select doc_id, nullif(text, '') as v from documents"),
    "string_dictionary": ("orders", ["o_orderkey", "nullif(o_orderpriority, '5-LOW') as v"], "select o_orderkey, nullif(o_orderpriority, '5-LOW') as v from orders"),
    "binary": ("documents", ["doc_id", "encode(text, 'UTF-8') as v"], "select doc_id, encode(text) as v from documents"),
    "decimal": ("orders", ["o_orderkey", "cast(o_totalprice as decimal(15,2)) as v"], "select o_orderkey, o_totalprice::decimal(15,2) as v from orders"),
    "date": ("orders", ["o_orderkey", "cast(o_orderdate as date) as v"], "select o_orderkey, o_orderdate::date as v from orders"),
    "timestamp": ("events", ["event_id", "nullif(ts, timestamp_ntz'1999-01-01') as v"], "select event_id, nullif(ts, timestamp '1999-01-01') as v from events"),
}


def _select(*expressions: str):
    def make(df):
        return df.selectExpr(*expressions)

    return make


_MAKE = {k: _select(*e) for k, (_, e, _) in _TYPES.items()}
for _name, (_table, _, _sql) in _TYPES.items():
    query(f"type_{_name}", _sql)(lambda spark, d, k=_name, t=_table: orc(spark, d, t, make=_MAKE[k]))
_CHAR = _select("o_orderkey", "cast(o_orderstatus as char(3)) as c", "cast(o_orderpriority as varchar(20)) as vc")
query("type_char", "select o_orderkey, rpad(o_orderstatus, 3, ' ') as c, o_orderpriority as vc from orders")(lambda spark, d: orc(spark, d, "orders", make=_CHAR).select("o_orderkey", F.rpad("c", 3, " ").alias("c"), "vc"))
_STRUCT = _select("c_custkey", "named_struct('x', c_nationkey, 'y', c_name) as st")
query("type_struct", "select c_custkey, c_nationkey as x, c_name as y from customer")(lambda spark, d: orc(spark, d, "customer", make=_STRUCT).select("c_custkey", "st.x", "st.y"))
_NULLS = _select("c_custkey", "if(c_custkey % 5 = 0, null, named_struct('x', nullif(c_nationkey, 3), 'y', c_name)) as st")
query("type_struct_nulls", "select c_custkey, c_custkey % 5 = 0 as gone, case when c_custkey % 5 <> 0 then nullif(c_nationkey, 3) end as x, case when c_custkey % 5 <> 0 then c_name end as y from customer")(lambda spark, d: orc(spark, d, "customer", make=_NULLS).select("c_custkey", F.col("st").isNull().alias("gone"), "st.x", "st.y"))
query("type_list", "select vec_id, len(embedding)::int as n, (generate_subscripts(embedding, 1) - 1)::int as pos, unnest(embedding) as x from embeddings")(lambda spark, d: orc(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("pos", "x")))
_MAP = _select("event_id", "map(event_type, value) as m")
query("type_map", "select event_id, event_type as k, case when event_type = 'click' then value end as v from events")(lambda spark, d: orc(spark, d, "events", make=_MAP).select("event_id", F.map_keys("m")[0].alias("k"), F.try_element_at("m", F.lit("click")).alias("v")))

# Statistics ----------------------------------------------------------------------------------------


def _stats(name, source, expression, sql, make=None):
    query(f"stats_{name}", sql)(lambda spark, d: statistics.file_stats(orc(spark, d, source).selectExpr(f"{expression} as v"), ["v"]))


_stats("int", "orders", "nullif(o_custkey, 5) - 700", "select count(v) as v_n, count(*) > count(v) as v_has_null, min(v) as v_min, max(v) as v_max, sum(v)::bigint as v_sum from (select nullif(o_custkey, 5) - 700 as v from orders)")
_stats("int_negative", "orders", "-o_custkey - 1", "select count(v) as v_n, count(*) > count(v) as v_has_null, min(v) as v_min, max(v) as v_max, sum(v)::bigint as v_sum from (select -o_custkey - 1 as v from orders)")
_stats("double", "orders", "round(o_totalprice) / 4", "select count(v) as v_n, count(*) > count(v) as v_has_null, min(v) as v_min, max(v) as v_max, sum(v) as v_sum from (select round(o_totalprice) / 4 as v from orders)")
_stats("string", "orders", "o_orderpriority", "select count(v) as v_n, count(*) > count(v) as v_has_null, min(v) as v_min, max(v) as v_max, sum(strlen(v))::bigint as v_sum from (select o_orderpriority as v from orders)")
_stats("string_long", "documents", "text", "select count(v) as v_n, count(*) > count(v) as v_has_null, case when strlen(min(v)) < 1024 then min(v) end as v_min, case when strlen(max(v)) < 1024 then max(v) end as v_max, sum(strlen(v))::bigint as v_sum from (select text as v from documents)")
_stats("bool", "orders", "nullif(o_orderstatus, 'P') = 'F'", "select count(v) as v_n, count(*) > count(v) as v_has_null, count(*) filter (v) as v_true from (select nullif(o_orderstatus, 'P') = 'F' as v from orders)")
_stats("decimal", "orders", "cast(o_totalprice as decimal(15,2))", "select count(v) as v_n, count(*) > count(v) as v_has_null, min(v) as v_min, max(v) as v_max, sum(v)::decimal(25,2) as v_sum from (select o_totalprice::decimal(15,2) as v from orders)")
_stats("date", "orders", "cast(o_orderdate as date)", "select count(v) as v_n, count(*) > count(v) as v_has_null, date_diff('day', date '1970-01-01', min(v))::int as v_min, date_diff('day', date '1970-01-01', max(v))::int as v_max from (select o_orderdate::date as v from orders)")
_stats("timestamp", "events", "ts", "select count(v) as v_n, count(*) > count(v) as v_has_null, epoch_us(min(v)) // 1000 as v_min, epoch_us(max(v)) // 1000 as v_max from (select ts as v from events)")
_stats("binary", "documents", "encode(text, 'UTF-8')", "select count(v) as v_n, count(*) > count(v) as v_has_null, sum(strlen(v))::bigint as v_sum from (select text as v from documents)")
_stats("nulls", "orders", "cast(null as bigint)", "select count(v) as v_n, count(*) > count(v) as v_has_null, min(v) as v_min, max(v) as v_max, sum(v)::bigint as v_sum from (select null::bigint as v from orders)")
query("row_index_int", "select o_orderkey // 1000 as stride, count(o_custkey) as o_custkey_n, false as o_custkey_has_null, min(o_custkey) as o_custkey_min, max(o_custkey) as o_custkey_max, sum(o_custkey)::bigint as o_custkey_sum from orders group by 1")(lambda spark, d: statistics.row_index_stats(orc(spark, d, "orders"), "o_orderkey", 1000, ["o_custkey"]))
query("row_index_string", "select o_orderkey // 1000 as stride, count(o_orderpriority) as o_orderpriority_n, false as o_orderpriority_has_null, min(o_orderpriority) as o_orderpriority_min, max(o_orderpriority) as o_orderpriority_max, sum(strlen(o_orderpriority))::bigint as o_orderpriority_sum from orders group by 1")(lambda spark, d: statistics.row_index_stats(orc(spark, d, "orders"), "o_orderkey", 1000, ["o_orderpriority"]))

# Footers ---------------------------------------------------------------------------------------------

_SMALL = WriterOptions(stripe_size=65_536, chunk_size=8_192)
query("footer_tail", "select count(*) as n_rows, 'ZLIB' as codec, 262144 as chunk_size, 10000 as row_index_stride, '0.12' as version from orders")(lambda spark, d: footer.tails(spark, orc_path(spark, d, "orders")).groupBy("codec", "chunk_size", "row_index_stride", "version").agg(F.sum("n_rows").alias("n_rows")))


@query("footer_stripes", "select 'lineitem' as name, count(*)::bigint as n_rows, true as several, 3::bigint as first_offset, 0::bigint as n_gaps from lineitem")
def footer_stripes(spark, d):
    """Stripes hold all rows, begin behind the magic bytes and follow each other without a gap."""
    own = footer.stripes(spark, orc_path(spark, d, "lineitem", _SMALL))
    end = F.col("offset") + F.col("index_bytes") + F.col("data_bytes") + F.col("footer_bytes")
    own = own.withColumn("gap", F.lead("offset").over(Window.partitionBy("file").orderBy("stripe")) - end)
    return own.agg(F.sum("n_rows").alias("n_rows"), (F.count(F.lit(1)) > 1).alias("several"), F.min("offset").alias("first_offset"), F.count_if(F.col("gap") != 0).alias("n_gaps")).select(F.lit("lineitem").alias("name"), "*")


@query("stripe_stats", "select true as several, count(*)::bigint as n_values, min(l_orderkey)::bigint as low, max(l_orderkey)::bigint as high, sum(l_orderkey)::bigint as total from lineitem")
def stripe_stats(spark, d):
    """A column's statistics over all stripes."""
    own = footer.stripe_statistics(spark, orc_path(spark, d, "lineitem", _SMALL)).where("column_id = 1")
    return own.agg((F.count(F.lit(1)) > 1).alias("several"), F.sum("n_values").alias("n_values"), F.min(F.col("min").cast("long")).alias("low"), F.max(F.col("max").cast("long")).alias("high"), F.sum(F.col("sum").cast("long")).alias("total"))


@query("footer_stats", "select 2 as column_id, count(*) as n_values, min(o_custkey)::varchar as low, max(o_custkey)::varchar as high, sum(o_custkey)::bigint::varchar as total from orders")
def footer_stats(spark, d):
    """A column's statistics over all files."""
    own = footer.file_statistics(spark, orc_path(spark, d, "orders")).where("column_id = 2")
    found = (f(F.col(n).cast("long")).cast("string").alias(x) for n, x, f in (("min", "low", F.min), ("max", "high", F.max), ("sum", "total", F.sum)))
    return own.agg(F.sum("n_values").alias("n_values"), *found).select(F.lit(2).alias("column_id"), "*")


def _by_strides(df):
    """Whole strides a file. Shuffled rows take more bytes than Parquet's, so there are more parts than the scan has."""
    return df.repartitionByRange(4 * df.rdd.getNumPartitions(), F.expr("o_orderkey div 1000"))


@query("footer_row_index", "select 2 as column_id, o_orderkey // 1000 as stride, count(*) as n_values, min(o_custkey)::varchar as low, max(o_custkey)::varchar as high, sum(o_custkey)::bigint::varchar as total from orders group by 2")
def footer_row_index(spark, d):
    """The row groups of all stripes and files, numbered by the strides of the keys."""
    path = orc_path(spark, d, "orders", WriterOptions(row_index_stride=1000, whole_strides=True), make=_by_strides, sort_by=["o_orderkey"])
    own = footer.strides_by_key(spark, path, "o_orderkey", "o_custkey", 1000)
    return own.select(F.lit(2).alias("column_id"), "stride", "n_values", *(F.col(n).cast("string").alias(x) for n, x in (("min", "low"), ("max", "high"), ("sum", "total"))))


query("footer_schema", "select 'struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:bigint,o_orderpriority:string>' as schema")(lambda spark, d: footer.tails(spark, orc_path(spark, d, "orders")).select("schema").distinct())
query("footer_user_metadata", "select 'org.apache.spark.version' as key, true as known, count(distinct 1)::bigint as n from orders")(lambda spark, d: footer.user_metadata(spark, orc_path(spark, d, "orders")).where("key = 'org.apache.spark.version'").groupBy("key", (F.col("value") == spark.version).alias("known")).agg(F.count_distinct("value").alias("n")))
query("footer_rows", "select count(*)::bigint as n from lineitem")(lambda spark, d: footer.tails(spark, orc_path(spark, d, "lineitem")).agg(F.sum("n_rows").alias("n")))

# Encodings -------------------------------------------------------------------------------------------


def _orders(spark, d):
    return orc(spark, d, "orders").select("o_orderkey", "o_custkey")


query("zigzag", "select o_orderkey, xor((o_orderkey - 7000) * 2, (o_orderkey - 7000) >> 63) as zz from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.zigzag(F.col("o_orderkey") - 7000).alias("zz")))
query("unzigzag", "select o_orderkey, xor(o_orderkey >> 1, -(o_orderkey & 1)) as v from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.unzigzag("o_orderkey").alias("v")))
_W = "case when o_custkey = 0 then 0 else length(bin(o_custkey))::int end"
query("bit_width", f"select o_orderkey, {_W} as w from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.bit_width("o_custkey").alias("w")))
_STEP = lambda w, steps: "case " + " ".join(f"when {w} <= {s} then {v}" for s, v in steps[:-1]) + f" else {steps[-1][1]} end"
_BIG = "(o_custkey * 4611686018427)"
_BW = f"case when {_BIG} = 0 then 0 else length(bin({_BIG}))::int end"
query("aligned_width", f"select o_orderkey, {_STEP(f'({_BW})', [(a, a) for a in bits.ALIGNED])} as w from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.aligned_width(bits.bit_width(F.col("o_custkey") * 4611686018427)).alias("w")))
query("width_code", f"select o_orderkey, {_STEP(f'({_BW})', [(w, k) for k, w in enumerate(bits.WIDTHS)])} as code from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.width_code(bits.bit_width(F.col("o_custkey") * 4611686018427)).alias("code")))
query("width_of_code", "select o_orderkey, [" + ", ".join(map(str, bits.WIDTHS)) + "][(o_orderkey % 32)::int + 1] as w from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.width_of_code((F.col("o_orderkey") % 32).cast("int")).alias("w")))
query("varint_len", f"select o_orderkey, greatest(1, ceil(({_BW}) / 7.0)::int) as n from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.varint_length(F.col("o_custkey") * 4611686018427).alias("n")))
query("varint_bytes", "select o_orderkey, case when o_custkey < 128 then printf('%02X', o_custkey) else printf('%02X', o_custkey % 128 + 128) || printf('%02X', o_custkey // 128) end as h from (select o_orderkey, o_custkey % 16384 as o_custkey from orders)")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.varint_hex(F.col("o_custkey") % 16384).alias("h")))
query("date_days", "select o_orderkey, date_diff('day', date '1970-01-01', o_orderdate::date)::int as d from orders")(lambda spark, d: orc(spark, d, "orders").select("o_orderkey", bits.date_days("o_orderdate").alias("d")))
query("days_date", "select o_orderkey, date '1970-01-01' + o_custkey::int as d from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.days_date(F.col("o_custkey").cast("int")).alias("d")))
query("ts_seconds_nanos", "select event_id, epoch_us(ts) // 1000000 - 1420070400 as secs, (epoch_us(ts) % 1000000) * 1000 as nanos from events")(lambda spark, d: orc(spark, d, "events").select("event_id", bits.timestamp_parts("ts").alias("p")).select("event_id", "p.secs", "p.nanos"))
_N = "(select event_id, (epoch_us(ts) % 1000000) * 1000 as n from events)"
query("nanos_scaled", f"select event_id, (case when n = 0 then 0 when n % 100 <> 0 then n << 3 else ((n // (10 ** tz)::bigint) << 3) | (tz - 1) end)::bigint as s from (select *, least(8, length(n::varchar) - length(rtrim(n::varchar, '0'))) as tz from {_N})")(lambda spark, d: orc(spark, d, "events").select("event_id", bits.nanos_scaled(bits.timestamp_parts("ts")["nanos"]).alias("s")))
query("nanos_round_trip", f"select event_id, n::bigint as n from {_N}")(lambda spark, d: orc(spark, d, "events").select("event_id", bits.nanos_plain(bits.nanos_scaled(bits.timestamp_parts("ts")["nanos"])).alias("n")))
query("present_bitmap", "select o_orderkey // 8 as byte_no, sum(case when o_orderstatus <> 'P' then 1 << (7 - o_orderkey % 8)::int else 0 end)::bigint as b from orders group by 1")(lambda spark, d: orc(spark, d, "orders").groupBy(F.expr("o_orderkey div 8").alias("byte_no")).agg(bits.present_byte(F.expr("nullif(o_orderstatus, 'P') is not null"), F.col("o_orderkey") % 8).alias("b")))
query("byte_runs", "with a as (select event_id, event_type, row_number() over (order by event_id) - row_number() over (partition by event_type order by event_id) as g from events) select event_type, min(event_id) as st, count(*) as ln from a group by event_type, g having count(*) >= 3")(lambda spark, d: bits.runs(orc(spark, d, "events"), "event_id", "event_type"))
_PREV = "lag(o_custkey) over (partition by o_orderkey // 512 order by o_orderkey)"


def _block():
    return Window.partitionBy(F.expr("o_orderkey div 512")).orderBy("o_orderkey")


query("delta_values", f"select o_orderkey, o_custkey - {_PREV} as delta from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", (F.col("o_custkey") - F.lag("o_custkey").over(_block())).alias("delta")))
query("rle_block_class", f"with a as (select o_orderkey // 512 as block, o_custkey as v, {_PREV} as p from orders) select block, case when count(distinct v) = 1 then 'REPEAT' when count(*) filter (v >= p) = count(*) - 1 or count(*) filter (v < p) = count(*) - 1 then 'DELTA' else 'DIRECT_OR_PATCHED' end as kind from a group by 1")(
    lambda spark, d: _orders(spark, d).select(F.expr("o_orderkey div 512").alias("block"), F.col("o_custkey").alias("v"), F.lag("o_custkey").over(_block()).alias("p")).groupBy("block").agg(F.expr("case when count(distinct v) = 1 then 'REPEAT' when count_if(v >= p) = count(*) - 1 or count_if(v < p) = count(*) - 1 then 'DELTA' else 'DIRECT_OR_PATCHED' end").alias("kind"))
)
query("patch_p90_width", f"select o_orderkey // 512 as block, quantile_disc({_W}, 0.9) as p90, max({_W}) as p100 from orders group by 1")(lambda spark, d: _orders(spark, d).select(F.expr("o_orderkey div 512").alias("block"), bits.bit_width("o_custkey").alias("w")).groupBy("block").agg(F.expr("percentile_disc(0.9) within group (order by w)").cast("int").alias("p90"), F.max("w").alias("p100")))
query("dict_table", "select o_orderpriority, (row_number() over (order by o_orderpriority) - 1)::int as code from (select distinct o_orderpriority from orders)")(lambda spark, d: bits.dictionary(orc(spark, d, "orders"), "o_orderpriority"))
query("dict_encode", "select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as code from orders")(lambda spark, d: bits.dictionary_encode(orc(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code"))


@query("dict_decode", "select o_orderkey, o_orderpriority from orders")
def dict_decode(spark, d):
    rows = orc(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    words = bits.dictionary(rows, "o_orderpriority")
    coded = bits.dictionary_encode(rows, "o_orderpriority").select("o_orderkey", "code")
    return bits.dictionary_decode(coded, words, "code", "o_orderpriority").select("o_orderkey", "o_orderpriority")


query("chunk_header", "select 100000 as length, false as original, '400d03' as h union all select 5, true, '0b0000'")(lambda spark, d: spark.createDataFrame([(100_000, False), (5, True)], "length int, original boolean").select("length", "original", bits.chunk_header(F.col("length"), F.col("original")).alias("h")))
#: A float's sign, exponent and fraction by arithmetic, as bytes from the lowest.
_BITS = """with v as (select vec_id, p, abs(x::double) as a, x < 0 as neg from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as p from embeddings)),
g as (select *, floor(log2(a)) as e0 from v where a > 0),
e as (select *, e0 + case when a >= 2.0 ** (e0 + 1) then 1 when a < 2.0 ** e0 then -1 else 0 end as e from g),
u as (select vec_id, p, (case when neg then 2147483648 else 0 end + (e + 127) * 8388608 + (a / 2.0 ** e - 1) * 8388608)::bigint as u from e union all select vec_id, p, 0 from v where a = 0)
select vec_id, string_agg(printf('%02x%02x%02x%02x', u & 255, (u >> 8) & 255, (u >> 16) & 255, (u >> 24) & 255), '' order by p) as h from u group by vec_id"""
query("float_bits_le", _BITS)(lambda spark, d: streams.float_bytes(orc(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("h")), "h").select("vec_id", F.lower(F.hex("h")).alias("h")))
query("float_round_trip", "select vec_id, embedding from embeddings")(lambda spark, d: streams.bytes_floats(streams.float_bytes(orc(spark, d, "embeddings").select("vec_id", "embedding"), "embedding"), "embedding"))
query("double_round_trip", "select o_orderkey, [o_totalprice, -o_totalprice] as x from orders")(lambda spark, d: streams.bytes_floats(streams.float_bytes(orc(spark, d, "orders").select("o_orderkey", F.array("o_totalprice", -F.col("o_totalprice")).alias("x")), "x", "double"), "x", "double"))
_WIDE = "(o_custkey - 700) * 1234567891"
query("varint_round_trip", f"select o_orderkey, {_WIDE} as v from orders")(lambda spark, d: _orders(spark, d).select("o_orderkey", bits.varint_value(bits.varint_hex(F.expr(_WIDE), True), True).alias("v")))


_GOLDEN = {
    "golden_rle_v2": [("short repeat", [10000] * 5, False, "0a2710"), ("direct", [23713, 57005, 43806, 48879], False, "5e035ca1deadab1ebeef"), ("delta", [2, 3, 5, 7, 11, 13, 17, 19, 23, 29], False, "c609020222424246"), ("patched", [2030, 2000, 2020, 1000000, *range(2040, 2200, 10)], True, "8e132b2107d01e00147028323c46505a646e78828c96a0aab4befce8")],
    "golden_byte_rle": [("zeros", [0] * 100, False, "6100"), ("literals", [0x44, 0x45], False, "fe4445"), ("mixed", [1, 5, 5, 5, 5, 1], False, "ff010105ff01")],
    "golden_bool_rle": [("first", [1, 0, 0, 0, 0, 0, 0, 0], False, "ff80"), ("run", [1] * 32, False, "01ff")],
}
_CODERS = {"golden_rle_v2": lambda v, s: rle.encode_ints(v, s), "golden_byte_rle": lambda v, s: rle.encode_bytes(bytes(v)), "golden_bool_rle": lambda v, s: rle.encode_bools(v)}


def _golden(name: str):
    def run(spark, d):
        import pandas as pd

        coder = _CODERS[name]

        def encode(batches):
            for rows in batches:
                yield pd.DataFrame({"name": rows["name"], "h": [coder([int(x) for x in v], bool(s)).hex() for v, s in zip(rows["v"], rows["s"])]})

        return ready(spark).createDataFrame([r[:3] for r in _GOLDEN[name]], "name string, v array<long>, s boolean").mapInPandas(encode, "name string, h string")

    return run


for _name, _rows in _GOLDEN.items():
    query(_name, "select * from (values " + ", ".join(f"('{r[0]}', '{r[3]}')" for r in _rows) + ") t(name, h)")(_golden(_name))
_DECODED = {"golden_byte_rle": streams.run_lengths_bytes, "golden_bool_rle": streams.run_lengths_bools}
for _name in _DECODED:
    query(f"{_name}_decoded", "select * from (values " + ", ".join(f"('{r[0]}', {[bool(x) for x in r[1]] if 'bool' in _name else r[1]}{'' if 'bool' in _name else '::tinyint[]'})" for r in _GOLDEN[_name]) + ") t(name, v)")(
        lambda spark, d, n=_name: _DECODED[n](spark.createDataFrame([(r[0], bytearray.fromhex(r[3])) for r in _GOLDEN[n]], "name string, v binary"), "v")
    )
_NULLABLE = "nullif(o_custkey % 97, 5) * 4611686018427"
query("rle_v2_roundtrip", f"select o_orderkey, {_NULLABLE} as v from orders")(lambda spark, d: rle.decode_column(rle.encode_column(orc(spark, d, "orders").selectExpr("o_orderkey", f"{_NULLABLE} as v"), "o_orderkey", "v"), "o_orderkey", "v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zlib file of events, scanned in batches with a projection."""
    return scan_batches_100(spark, sf_dir)
