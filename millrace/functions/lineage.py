"""Cutting lineage by tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where spark.checkpoint.dir is unset on one machine: a temporary folder for each application.
_LOCAL: dict[str, str] = {}


class Scratch:
    """Owns the tables and folders made inside its ``with`` block, by this thread; others of the process are not touched.

    ``delete`` removes them once nothing will read them any more. A scope in a scope owns what is made inside it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def __enter__(self) -> Scratch:
        self._token = _SCOPE.set(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPE.reset(self._token)

    def delete(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = set()


_SCOPE: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; a local folder stands in where it is unset on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-millrace-", dir="/tmp")
        base = _LOCAL[app]
    path = f"{base.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
    if (scope := _SCOPE.get()) is not None:
        scope.paths.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made, once nothing will read them any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)
