"""What ORC footers say, as DataFrames: tails, stripes, row indexes and statistics of files and stripes.

The driver only lists the files. Their tails are read in tasks, each some kilobytes of its file, so the
footers of very many files take as long as their share of tasks. Values of statistics are text, as types
differ: numbers in decimal, dates in days and timestamps in milliseconds (UTC) since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import flatten
from ..store import ready
from .files import read_orc

_STATS = "n_values long, has_null boolean, bytes_on_disk long, min string, max string, sum string, n_true long"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file, size of the data files below a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, listed = [], root.getFileSystem(conf).listFiles(root, True)
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().getName()
        if f.getLen() > 3 and not name.startswith(("_", ".")):
            found.append((f.getPath().toString(), name, f.getLen()))
    rows = spark.createDataFrame(found, "path string, file string, size long")
    return rows.repartition(min(len(found), 4 * spark.sparkContext.defaultParallelism)) if len(found) > 1 else rows


def _opened(path: str):
    """A file of any file system that Arrow knows; plain paths and file: URIs are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path[5:].replace("//", "/") if path.startswith("file://") else path[5:])
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _rows(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    """make(read, tail) gives a file's rows, without its name. A task holds one file's rows."""
    import pandas as pd

    from .tail import read_tail

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for files in batches:
            for at, name, size in zip(files["path"], files["file"], files["size"]):
                with _opened(at) as f:

                    def read(offset: int, length: int, f=f) -> bytes:
                        return f.read_at(length, offset)

                    yield pd.DataFrame([(name, *r) for r in make(read, read_tail(read, size))], columns=["file", *names]).astype(object)

    return list_files(ready(spark), path).mapInPandas(run, f"file string, {schema}")


def _values(s: dict) -> tuple:
    return tuple(s[k] for k in ("n_values", "has_null", "bytes_on_disk", "min", "max", "sum", "n_true"))


def tails(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: rows, bytes, codec, chunk size, row index stride, version, stripes, schema."""
    return _rows(spark, path, "n_rows long, content_bytes long, codec string, chunk_size int, row_index_stride int, version string, n_stripes int, schema string", lambda read, t: [(t.n_rows, t.content_bytes, t.codec, t.chunk_size, t.stride, t.version, len(t.stripes), t.schema())])


def stripes(spark: SparkSession, path: str) -> DataFrame:
    """One row a stripe: its place, its parts' lengths and its rows."""
    return _rows(spark, path, "stripe int, offset long, index_bytes long, data_bytes long, footer_bytes long, n_rows long", lambda read, t: [(k, *s.values()) for k, s in enumerate(t.stripes)])


def file_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row a file and column id, as the file's writer counted."""
    return _rows(spark, path, f"column_id int, {_STATS}", lambda read, t: [(c, *_values(s)) for c, s in enumerate(t.statistics)])


def stripe_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, stripe and column id."""
    return _rows(spark, path, f"stripe int, column_id int, {_STATS}", lambda read, t: [(k, c, *_values(s)) for k, own in enumerate(t.stripe_statistics) for c, s in enumerate(own)])


def row_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, stripe, column id and row group: where its streams begin, and its statistics."""
    from .tail import read_row_index

    return _rows(spark, path, f"stripe int, column_id int, stride int, positions array<long>, {_STATS}", lambda read, t: [(k, c, n, p, *_values(s)) for k, c, n, p, s in read_row_index(read, t)])


def strides_by_key(spark: SparkSession, path: str, key: str, value: str, stride: int) -> DataFrame:
    """stride, n_values, min, max, sum of an integer column by key div stride, from row indexes.

    A stripe's row groups are numbered from 0 again, so a group's place is told by its own keys. All rows of
    a stride must be in one file. Files that have a row group across strides (keys with gaps, or equal or
    null ones, or stripes that end within a stride) are counted from their rows.
    """
    df = read_orc(spark, path)
    ids = {c.path: c.id for c in flatten(df.schema)}
    of = lambda name, c: F.max(F.when(F.col("column_id") == ids[c], F.col(name)))
    index = row_index(spark, path).where(F.col("column_id").isin(ids[key], ids[value])).groupBy("file", "stripe", "stride")
    groups = index.agg(*(of(n, key).cast("long").alias(f"key_{n}") for n in ("min", "max")), of("has_null", key).alias("no_key"), *(of(n, value).cast("long").alias(n) for n in ("n_values", "min", "max", "sum")))
    groups = groups.select("file", F.expr(f"key_min div {stride}").alias("stride"), F.expr(f"no_key or coalesce(key_min div {stride} <> key_max div {stride}, true)").alias("across"), "n_values", "min", "max", "sum")
    across = [r[0] for r in groups.where("across").select("file").distinct().collect()]
    found = groups.where(~F.col("file").isin(across)) if across else groups
    out = found.groupBy("stride").agg(F.sum("n_values").alias("n_values"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))
    if across:
        rows = read_orc(spark, [f"{path}/{name}" for name in across], df.schema).groupBy(F.expr(f"`{key}` div {stride}").alias("stride"))
        out = out.unionByName(rows.agg(F.count(value).alias("n_values"), *(f(value).cast("long").alias(n) for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum)))))
    return out


def user_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a file and key that its writer left in the footer."""
    return _rows(spark, path, "key string, value string", lambda read, t: [(k, v.decode("utf-8", "replace")) for k, v in t.user_metadata.items()])


def number_of_rows(spark: SparkSession, path: str) -> int:
    return int(tails(spark, path).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0])
