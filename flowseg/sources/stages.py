"""Stage reuse: a finished stage table is read back, otherwise it is built and stored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowseg.sources.files import load, save


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage_exists(spark: SparkSession, path: str) -> bool:
    """True once the write has been committed, on any Hadoop file system."""
    return path_exists(spark, f"{path}/_SUCCESS")


def _settings_mark(settings: str) -> str:
    return f"_settings-{hashlib.sha256(settings.encode()).hexdigest()[:32]}"


def stage_mark(spark: SparkSession, path: str) -> str:
    """The mark of the settings that a stored stage was built with; empty without one."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/_settings-*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return "".join(sorted(f.getPath().getName() for f in found or []))


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], settings: str | None = None) -> DataFrame:
    """Read the stage at ``path``; build and write it first where it is missing.

    With ``settings`` (whatever the result depends on, as text) a stage that was built
    with others, or without any, is built anew. Their fingerprint is the name of an empty
    file beside ``_SUCCESS``, written last, so a build that was cut off is repeated.
    """
    mark = None if settings is None else f"{path}/{_settings_mark(settings)}"
    if not stage_exists(spark, path) or (mark and not path_exists(spark, mark)):
        save(build(), path)
        if mark:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(mark)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()
    return load(spark, path)
