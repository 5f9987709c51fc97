"""Encodings, row groups and page indexes of token files, and how many parts they have."""

import pytest

pytest.importorskip("tokenizers")
import glob

import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from colonnade.llm import tokenio

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("encoding, coded", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_files_are_laid_out_as_asked(spark, tmp_path, encoding, coded):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 20), k -> sha2(concat(id, 'x', k), 256)), ' ')").alias("text"))
    path = tokenio.write_tokens(docs, f"file://{tmp_path}/t", PATH, 2, encoding=encoding, row_group_bytes=256 << 10, page_bytes=16 << 10, partitions=2)
    files = sorted(glob.glob(f"{tmp_path}/t/*.parquet"))
    assert len(files) == 2
    meta = pq.ParquetFile(files[0]).metadata
    column = next(k for k in range(meta.num_columns) if meta.schema.column(k).path.startswith("tokens"))
    chunk = meta.row_group(0).column(column)
    assert coded in chunk.encodings and chunk.has_offset_index and meta.row_group(0).column(0).has_column_index
    assert meta.num_row_groups > 2 and chunk.total_uncompressed_size < 1 << 20
    one = tokenio.read_tokens(spark, path).where("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def test_parts_follow_the_input(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    path = tokenio.write_tokens(docs, f"file://{tmp_path}/t", PATH, 2, partition_bytes=10_000)
    assert spark.read.parquet(path).select("part").distinct().count() > 4
