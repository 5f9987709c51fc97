"""Reading and writing ORC by Spark's own source; options by the names of the file format."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CODECS = ("none", "zlib", "snappy", "zstd", "lz4", "lzo")
_BATCH_ROWS = "spark.sql.orc.columnarWriterBatchSize"


@dataclass(frozen=True)
class WriterOptions:
    """Layout of the files; the defaults suit scans that are split over many executors.

    whole_strides: stripes end only where a stride ends, so that all row groups but a file's last are full ones.
    block_padding: zeros before a stripe that else would begin shortly before a file system's block ends; without it stripes leave no gap.
    """

    codec: str = "zlib"
    stripe_size: int = 64 << 20
    chunk_size: int = 256 << 10
    row_index_stride: int = 10_000
    create_index: bool = True
    bloom_columns: tuple[str, ...] = ()
    dictionary_threshold: float = 0.8
    whole_strides: bool = False
    block_padding: bool = False
    more: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec!r}; there are {', '.join(CODECS)}")
        if self.create_index and self.row_index_stride < 1_000:
            raise ValueError("a row index needs a stride of 1,000 rows or more")

    def as_options(self) -> dict[str, str]:
        out = {
            "compression": self.codec,
            "orc.stripe.size": self.stripe_size,
            "orc.compress.size": self.chunk_size,
            "orc.row.index.stride": self.row_index_stride,
            "orc.create.index": str(self.create_index).lower(),
            "orc.dictionary.key.threshold": self.dictionary_threshold,
            "orc.block.padding": str(self.block_padding).lower(),
        }
        if self.whole_strides:
            out["orc.rows.between.memory.checks"] = self.row_index_stride * -(-5_000 // self.row_index_stride)
        if self.bloom_columns:
            out["orc.bloom.filter.columns"] = ",".join(self.bloom_columns)
        return {k: str(v) for k, v in {**out, **self.more}.items()}

    @property
    def batch_rows(self) -> int:
        """Rows that the writer takes at once. It may end a stripe behind any batch, so for whole strides a stride is some batches."""
        return next(n for n in range(1_024, 0, -1) if not self.whole_strides or self.row_index_stride % n == 0)


def write_orc(df: DataFrame, path: str, options: WriterOptions = WriterOptions(), mode: str = "overwrite", sort_by: list[str] | None = None, files: int | None = None, partition_by: list[str] | None = None) -> str:
    """Writes df. sort_by sorts within each file, so that row groups hold narrow ranges that scans
    prune; files ranges the rows over so many files by it (one shuffle), else no shuffle is added."""
    if sort_by and files:
        df = df.repartitionByRange(files, *sort_by)
    elif files:
        df = df.coalesce(files) if files < df.rdd.getNumPartitions() else df.repartition(files)
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).options(**options.as_options())
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = df.sparkSession.conf.get(_BATCH_ROWS)
    try:
        if options.whole_strides:
            df.sparkSession.conf.set(_BATCH_ROWS, options.batch_rows)
        writer.orc(path)
    finally:
        df.sparkSession.conf.set(_BATCH_ROWS, before)
    return path


def read_orc(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, merge_schema: bool = False) -> DataFrame:
    """A scan; what is selected and filtered later reaches the files as projection and predicates."""
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.orc(path)


def count_and_bounds(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows, and least and greatest value of columns, from the footers alone where they suffice."""
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.sources.useV1SourceList"), spark.conf.get("spark.sql.orc.aggregatePushdown")
    try:
        spark.conf.set("spark.sql.sources.useV1SourceList", "")
        spark.conf.set("spark.sql.orc.aggregatePushdown", "true")
        found = read_orc(spark, path).agg(F.count(F.lit(1)).alias("n_rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
        found._jdf.queryExecution().executedPlan()  # planned while the settings hold
        return found
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before[0])
        spark.conf.set("spark.sql.orc.aggregatePushdown", before[1])
