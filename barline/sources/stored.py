"""Derived tables and models kept under the shared checkpoint folder, built once per session.

A rollup that seventy indicator jobs read is a table, not a sub-plan to repeat in each of them.
Files survive the loss of executors, unlike cached partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barline.session import scratch_path

_PATHS: dict[tuple, str] = {}


def source_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, length and time of change of every entry of a folder, so that what was derived from
    tables that have changed since is built anew."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def stored_path(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` has filled for ``name`` in this session and over these source tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name, source_state(spark, sf_dir))
    if key not in _PATHS:
        path = scratch_path(spark, name)
        build(path)
        _PATHS[key] = path
    return _PATHS[key]


def forget(paths: list[str]) -> None:
    """Drops entries whose folders are gone."""
    gone = set(paths)
    for key in [k for k, path in _PATHS.items() if path in gone]:
        del _PATHS[key]


def stored(spark: SparkSession, sf_dir: str, name: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(stored_path(spark, sf_dir, name, lambda path: build().write.parquet(path)))


def stage(df: DataFrame, name: str) -> DataFrame:
    """A written stage boundary: what follows reads the rows instead of recomputing them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
