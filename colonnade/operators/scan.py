"""Projection, row numbers, batches, seek and skip."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import names_of
from ..store import materialize


def project_ids(df: DataFrame, ids: list[int]) -> DataFrame:
    """Columns by their pre-order ids; fields of structs come out under their dotted paths."""
    return df.select(*columns_of(df, ids))


def columns_of(df: DataFrame, ids: list[int]) -> list[Column]:
    names = names_of(df.schema, ids)
    return [F.col(".".join(f"`{p}`" for p in n.split("."))).alias(n.replace(".", "_")) for n in names]


def with_row_no(df: DataFrame, order_by: list[str], name: str = "row_no") -> DataFrame:
    """Numbers rows from 0 in the order of order_by, without one task that sees them all.

    Rows are ranged over partitions and sorted in each; a row's number is its place in its partition plus
    the sizes of the partitions before, of which there is one small row each.
    """
    part, at, base = (_free(df, n) for n in ("part", "at", "base"))
    own = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = materialize(own.select("*", F.spark_partition_id().alias(part), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias(at)), "row-no")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    return placed.join(F.broadcast(starts), part).select(*(placed[f"`{c}`"] for c in df.columns), (F.col(base) + F.col(at)).alias(name))


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = "_" + name
    return name


def batch_no(row_no: str, size: int):
    """The number of a row's batch of so many rows."""
    if size < 1:
        raise ValueError("a batch has one row or more")
    return F.expr(f"`{row_no}` div {size}")


def batches(df: DataFrame, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The rows in Arrow batches of ``size``, the last one of what is left.

    Tasks send their Arrow batches as they are; one partition at a time (and the next, ahead) is on
    the driver, however large the table.
    """
    if size < 1:
        raise ValueError("a batch has one row or more")

    def run(found):
        for batch in found:
            for at in range(0, batch.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    def whole(tables: list[pa.Table], first: int, n: int) -> pa.RecordBatch:
        return pa.concat_tables(tables).slice(first, n).combine_chunks().to_batches()[0]

    held: list[pa.Table] = []
    n = 0
    for row in df.mapInArrow(run, "batch binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(row[0]).read_all())
        n += held[-1].num_rows
        if n >= size:
            yield whole(held, 0, size)
            held, n = ([pa.concat_tables(held).slice(size)], n - size) if n > size else ([], 0)
    if n:
        yield whole(held, 0, n)


def seek(df: DataFrame, row: int, row_no: str = "row_no") -> DataFrame:
    """From row ``row`` on: a predicate that prunes stripes and row groups of files sorted by row_no."""
    if row < 0:
        raise ValueError("rows are numbered from 0")
    return df.where(F.col(row_no) >= row)


def seek_stride(df: DataFrame, stride: int, size: int, row_no: str = "row_no") -> DataFrame:
    """From the first row of a stride (row group) on."""
    return seek(df, stride * size, row_no)


def skip(df: DataFrame, rows: int, row_no: str = "row_no", after: int = 0) -> DataFrame:
    """Leaves out so many rows after a position."""
    return df.where((F.col(row_no) < after) | (F.col(row_no) >= after + rows))


def read_rows(df: DataFrame, first: int, n: int, row_no: str = "row_no") -> DataFrame:
    """n rows from one on: both ends reach the scan."""
    return df.where(F.col(row_no).between(first, first + n - 1))


def row_position(row_no: str, stride: int):
    """The stride of a row and its place in it."""
    return F.struct(F.expr(f"`{row_no}` div {stride}").alias("stride"), F.expr(f"`{row_no}` % {stride}").alias("offset"))


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails in the task that meets a null where the schema has none, without a pass of its own."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c)))
    return df
