"""Streams of bytes as columns: floats, doubles and run-length coded bytes and bits, both ways, by Arrow batches.

Values travel as flat Arrow buffers that numpy reinterprets, never row by row where the format allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DoubleType, FloatType, StructField, StructType

from ..store import ready
from . import rle

_FLOATS = {"float": ("<f4", FloatType(), pa.float32()), "double": ("<f8", DoubleType(), pa.float64())}


def _mapped(df: DataFrame, value: str, kind: DataType, make) -> DataFrame:
    """df with its column value replaced by make's Arrow array of it."""
    at = df.columns.index(value)
    plain = ready(df.sparkSession) and df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    schema = StructType([StructField(f"c{at}", kind) if i == at else f for i, f in enumerate(plain.schema)])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([make(c) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return plain.mapInArrow(run, schema).toDF(*df.columns)


def _cut(data: bytes, sizes: np.ndarray, nulls: np.ndarray) -> list[bytes | None]:
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [None if no else data[a:b] for a, b, no in zip(ends, ends[1:], nulls.tolist())]


def float_bytes(df: DataFrame, value: str, kind: str = "float") -> DataFrame:
    """Lists of floats or doubles as the little-endian bytes that a DATA stream holds; null lists stay null."""
    code, _, _ = _FLOATS[kind]

    def make(column):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(code)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) * flat.dtype.itemsize
        return pa.array(_cut(flat.tobytes(), sizes, column.is_null().to_numpy(zero_copy_only=False)), pa.binary())

    return _mapped(df, value, BinaryType(), make)


def bytes_floats(df: DataFrame, value: str, kind: str = "float") -> DataFrame:
    """The lists of float_bytes again."""
    code, spark_kind, arrow_kind = _FLOATS[kind]

    def make(column):
        parts = column.to_pylist()
        flat = np.frombuffer(b"".join(p or b"" for p in parts), code)
        offsets = np.concatenate([[0], np.cumsum([len(p or b"") // flat.dtype.itemsize for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, arrow_kind), mask=column.is_null())

    return _mapped(df, value, ArrayType(spark_kind), make)


def run_lengths_bytes(df: DataFrame, value: str) -> DataFrame:
    """The bytes (signed) of run-length coded ones."""
    return _mapped(df, value, ArrayType(ByteType()), lambda column: pa.array([None if x is None else np.frombuffer(bytes(rle.decode_bytes(x)), np.int8) for x in column.to_pylist()], pa.list_(pa.int8())))


def run_lengths_bools(df: DataFrame, value: str) -> DataFrame:
    """The bits of run-length coded ones, eight for each byte."""

    def bits(x: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bytes(rle.decode_bytes(x)), np.uint8)).astype(bool)

    return _mapped(df, value, ArrayType(BooleanType()), lambda column: pa.array([None if x is None else bits(x) for x in column.to_pylist()], pa.list_(pa.bool_())))
