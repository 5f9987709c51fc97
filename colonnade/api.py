"""Files as objects: a reader with batches and seek, a writer; thin over DataFrames.

    with Reader(spark, path) as file:
        file.number_of_rows, file.schema_table(), file.options(), file.statistics()
        cursor = file.batches(ids=[0, 1, 4], size=10_000)
        cursor.seek(1_500)
        for batch in cursor: ...
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .operators import scan
from .schema import Column, flatten, schema_table
from .sources import footer
from .sources.files import WriterOptions, read_orc, write_orc


#: Rows that a cursor with row numbers reads at once, at least a batch.
WINDOW_ROWS = 1 << 16
_ROW = "__row_no"


class Reader:
    """The ORC files at a path. Nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str | None = None):
        self.spark, self.path = spark, path
        self.df = read_orc(spark, path, schema)

    @property
    def schema(self) -> list[Column]:
        return flatten(self.df.schema)

    def schema_table(self) -> DataFrame:
        return schema_table(self.spark, self.df.schema)

    @property
    def number_of_rows(self) -> int:
        """From the footers."""
        return footer.number_of_rows(self.spark, self.path)

    def options(self) -> DataFrame:
        """codec, chunk_size, row_index_stride as the files have them, one row a kind."""
        return footer.tails(self.spark, self.path).select("codec", "chunk_size", "row_index_stride").distinct()

    def statistics(self) -> DataFrame:
        return footer.file_statistics(self.spark, self.path)

    def scan(self, ids: list[int] | None = None) -> DataFrame:
        return scan.project_ids(self.df, ids or [])

    def batches(self, ids: list[int] | None = None, size: int = 10_000, row_no: str | None = None) -> BatchCursor:
        """A cursor. row_no names a column that numbers the rows from 0; files sorted by it are sought by predicate, without a sort of the rest."""
        return BatchCursor(self, ids, size, row_no)

    def close(self) -> None:
        self.df = None

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class BatchCursor:
    """Arrow batches of at most so many rows; ``next`` gives None at the end."""

    def __init__(self, file: Reader, ids: list[int] | None, size: int, row_no: str | None):
        if size < 1:
            raise ValueError("a batch has one row or more")
        self.file, self.ids, self.size, self.row_no = file, ids, size, row_no
        self._own: Iterator[pa.RecordBatch] | None = None
        self._from = 0

    def _start(self) -> Iterator[pa.RecordBatch]:
        if self.row_no:
            return self._windows()
        own = self.file.df.offset(self._from) if self._from else self.file.df
        return scan.batches(scan.project_ids(own, self.ids or []), self.size)

    def _window(self, first: int, n: int) -> DataFrame:
        """n rows from first on, by a range of row numbers that files, stripes and row groups are pruned by; nothing is shuffled."""
        rows = self.file.df.where(F.col(self.row_no).between(first, first + n - 1))
        return rows.select(*scan.columns_of(rows, self.ids or []), F.col(self.row_no).alias(_ROW))

    def _windows(self) -> Iterator[pa.RecordBatch]:
        """Windows of some batches each, one after the other, sorted where they are small."""
        step = self.size * max(1, WINDOW_ROWS // self.size)
        for first in range(self._from, self.file.number_of_rows, step):
            table = self._window(first, step).toArrow().sort_by(_ROW).drop_columns([_ROW])
            yield from table.combine_chunks().to_batches(max_chunksize=self.size)

    def next(self) -> pa.RecordBatch | None:
        if self._own is None:
            self._own = self._start()
        return next(self._own, None)

    def seek(self, row: int) -> None:
        """The next batch begins at this row; behind the last row there is none."""
        if row < 0 or row > self.file.number_of_rows:
            raise ValueError(f"there is no row {row}")
        self._from, self._own = row, None

    def close(self) -> None:
        self._own = iter(())

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        while (batch := self.next()) is not None:
            yield batch


class Writer:
    """Writes DataFrames to one path: the first replaces what is there, later ones are appended."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, options: WriterOptions = WriterOptions()):
        self.spark, self.path, self.options = spark, path, options
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        flatten(self.schema)  # fails for types that the format lacks
        self._written = False

    def write(self, rows: DataFrame | pa.Table | pa.RecordBatch) -> None:
        """Rows must have the schema's columns; what the schema calls not null is checked as it is written."""
        if isinstance(rows, pa.RecordBatch):
            rows = pa.Table.from_batches([rows])
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows)
        df = scan.check_not_null(df.to(StructType([f.__class__(f.name, f.dataType, True) for f in self.schema])), [f.name for f in self.schema if not f.nullable])
        write_orc(df, self.path, self.options, mode="append" if self._written else "overwrite")
        self._written = True

    def close(self) -> None:
        """An unused writer leaves files with the schema and no row."""
        if not self._written:
            self.write(self.spark.createDataFrame([], self.schema))

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.close()
