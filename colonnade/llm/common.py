"""Column names and pass-through beside the library's plumbing, which the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from ..store import materialize, new_path, ready, scratch, shared_dir

__all__ = ["free_name", "map_rows", "materialize", "new_path", "ready", "scratch", "shared_dir"]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, for helper columns beside unknown extra ones."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def map_rows(df: DataFrame, run, extra: list[StructField] = []) -> DataFrame:
    """mapInArrow over all columns, whatever their names are (dots and clashes too), and extra ones behind."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    schema = StructType([*plain.schema.fields, *extra])
    return plain.mapInArrow(run, schema).toDF(*df.columns, *(f.name for f in extra))
