"""Intermediate tables in the folder that the session names for checkpoints."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def staging_folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:  # a local session without a shared folder, as in tests
        _own.append("file://" + tempfile.mkdtemp(prefix="lexispark-"))
    return _own[0]


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Plans made within don't fuse operators into methods that the JVM won't compile: the
    stemmer's steps run three times as fast apart."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_folder(spark: SparkSession, make: bool = True) -> str:
    """The path of a folder that goes with the session, made or to be."""
    path = f"{staging_folder(spark)}/staged-{uuid.uuid4().hex}"
    _made.append((spark, path))
    if make:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a table: computed once, whatever reads it, and no deeper plan."""
    spark = df.sparkSession
    path = new_folder(spark, make=False)
    with small_methods(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended
            return
