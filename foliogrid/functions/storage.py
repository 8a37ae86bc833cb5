"""Cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured (local tests)."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="foliogrid-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


#: Paths of the tables that were written in each open scope of ``intermediates``, the innermost last.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end all tables are deleted that operators wrote within it.

    Results are lazy and may read such tables: write what is wanted before the scope ends, by other means than
    ``materialize``, or in an outer scope. Scopes are a matter of one driver thread.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)
