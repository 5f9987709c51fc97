"""The shared folder, tables written to cut lineage, and what Python workers need to import."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_TABLES: list[tuple[weakref.ref, str]] = []
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even where it isn't installed (local runs)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where that is unset, a local master gets a temporary folder; a cluster's executors couldn't read the
    driver's, so there it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colonnade-")
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder, deleted when its scratch() or the session's Python ends."""
    path = f"{shared_dir(spark)}/colonnade/{name}-{uuid.uuid4().hex}"
    _TABLES.append((weakref.ref(spark), path))
    held = _SCRATCH.get()
    if held is not None:
        held.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back.

    What is read later survives the loss of any executor. The table is deleted when the scratch()
    around it ends, else with the session's Python, as lazy results may read it until then.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables made within, at its end, but for those that the function it gives has written.

    Scratches nest: what an inner one keeps is deleted by the outer one.
    """
    outer = _SCRATCH.get()
    token = _SCRATCH.set([])
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(_SCRATCH.get()[-1])
        return out

    try:
        yield keep
    finally:
        made = _SCRATCH.get()
        _SCRATCH.reset(token)
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def _delete(spark: SparkSession | None, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and with it the means to delete
        return
    _TABLES[:] = [t for t in _TABLES if t[1] != path]


@atexit.register
def _drop_tables() -> None:
    for ref, path in list(_TABLES):
        _delete(ref(), path)
