"""Column statistics with the meaning of the file format: per file (all rows) and per row group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType

from ..functions.bits import utc_micros

#: Longer strings have bounds in place of values.
STRING_LIMIT = 1024


def aggregates(name: str, kind: DataType) -> list[Column]:
    """The statistics of one column, each under the column's name and its own."""
    c = F.col(name)
    out = [F.count(c).alias(f"{name}_n"), (F.count(F.lit(1)) > F.count(c)).alias(f"{name}_has_null")]
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        out += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.sum(c.cast("long")).alias(f"{name}_sum")]
    elif isinstance(kind, (FloatType, DoubleType, DecimalType)):
        out += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.sum(c).alias(f"{name}_sum")]
    elif isinstance(kind, StringType):
        low, high = F.min(c), F.max(c)
        cut = lambda x: F.when(F.octet_length(x) < STRING_LIMIT, x)
        out += [cut(low).alias(f"{name}_min"), cut(high).alias(f"{name}_max"), F.sum(F.octet_length(c)).alias(f"{name}_sum")]
    elif isinstance(kind, BooleanType):
        out.append(F.count_if(c).alias(f"{name}_true"))
    elif isinstance(kind, DateType):
        days = F.datediff(c, F.lit("1970-01-01").cast("date"))
        out += [F.min(days).alias(f"{name}_min"), F.max(days).alias(f"{name}_max")]
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        ms = F.floor(utc_micros(c) / 1000)
        out += [F.min(ms).alias(f"{name}_min"), F.max(ms).alias(f"{name}_max")]
    elif isinstance(kind, BinaryType):
        out.append(F.sum(F.octet_length(c)).alias(f"{name}_sum"))
    return out


def file_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: the statistics of the columns over all rows."""
    return df.agg(*(a for c in columns or df.columns for a in aggregates(c, df.schema[c].dataType)))


def row_index_stats(df: DataFrame, row_no: str, stride: int, columns: list[str]) -> DataFrame:
    """One row a stride of so many rows, the last one of what is left."""
    return df.groupBy(F.expr(f"`{row_no}` div {stride}").alias("stride")).agg(*(a for c in columns for a in aggregates(c, df.schema[c].dataType)))
