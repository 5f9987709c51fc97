"""Token ids as Parquet: list columns, controlled row groups and pages, page indexes.

``write_tokens`` encodes documents and writes them in ascending doc_id order; ``read_tokens``
reads the tokens or the metadata alone. The layout, one row a document:

    doc_id, part int, local_start long, n_tokens int, tokens array<int>

Files are made by Spark's own Parquet writer and commit protocol, so a lost executor costs no
more than its tasks. Token ids are dictionary-coded (vocabularies of up to 64 K take 16 bits a
token) and fall back, where a column chunk has too many distinct ids, to delta encoding under
the format's version 2; row groups and pages have fixed sizes, and each column chunk carries a
column and offset index, so a read for few documents or of metadata alone touches little.

Edge cases: a null text is encoded as empty and holds the end id alone; null doc_ids come first;
rows that share a doc_id are kept, in the order of their texts' hashes; an empty table gives empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import encode
from .common import new_path, ready


def _planned_bytes(df: DataFrame) -> int:
    """What the optimiser takes df's size for (of files, theirs); 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, partitions: int | None = None, partition_bytes: int = 128 << 20) -> str:
    """Writes the ids of all documents, each with end_id after it. encoding: dictionary or delta.

    There are as many parts as the session shuffles to, and more where the planned size of the input asks for it.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_planned_bytes(rows) // partition_bytes))
    # The order of doc_id, equal ones by a hash of their texts and by the texts: the same whichever executor
    # makes a partition again, and rows without an id, however many, are ranged over partitions, too.
    hashed = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text").asc_nulls_first()]
    ordered = hashed.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        coder, at = encode.encoder(tokenizer), 0
        for batch in batches:
            for block in encode.blocks(batch, "text"):
                ids, offsets = coder.encode(block.column("text"))
                ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
                offsets = offsets + np.arange(len(offsets))
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("part"), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), tokens], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
                at += int(offsets[-1])

    out = ordered.mapInArrow(run, f"doc_id {kind}, part int, local_start long, n_tokens int, tokens array<int>")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.dictionary.page.size": 1 << 20, "parquet.writer.version": "v2", "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.page.row.count.limit": 1000}
    out.write.options(**{k: str(v) for k, v in options.items()}).option("compression", "zstd").mode("overwrite").parquet(path)
    return path


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start of each document, without reading a token."""
    return _with_start(spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens"), spark, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and tokens; a filter on doc_id prunes row groups and pages."""
    return _with_start(spark.read.parquet(path), spark, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """start: the ids of all parts before plus those before in the part. One row a part is broadcast."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over parts, not rows
    base = totals.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that have tokens array<int>."""
    ready(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "tokens").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Writes all documents to a new folder of the shared directory and digests what is read back."""
    spark = docs.sparkSession
    path = write_tokens(docs, new_path(spark, "tokens"), tokenizer, end_id, **options)
    return checksums(read_tokens(spark, path))
