"""ORC folders as streams: new files are read as they come, results are appended as ORC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.files import WriterOptions


def stream_orc(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """The rows of files that enter a folder; a stream's schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).orc(path)


def windowed_stats(rows: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "10 minutes", by: list[str] = []) -> DataFrame:
    """Count, least, greatest and sum of a value by event-time window, with late rows up to a limit."""
    timed = rows.withWatermark(time, late)
    return timed.groupBy(F.window(time, window), *by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"))


def append_orc(rows: DataFrame, path: str, checkpoint: str, options: WriterOptions = WriterOptions(), once: bool = True):
    """Starts the query that appends to a folder of ORC files, exactly once by its checkpoint."""
    writer = rows.writeStream.format("orc").options(**options.as_options()).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
