"""Shared folders, intermediate tables and size-checked joins.

Intermediate results live as Parquet tables in the folder that the cluster
names in ``spark.checkpoint.dir``, so that a lost executor costs a re-read,
never a recomputation of everything before it.
"""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side may be broadcast; rows are taken at their measured width.
BROADCAST_BYTES = 24 << 20
#: What a row of a few longs takes in a broadcast relation, about.
ROW_BYTES = 48

_made: dict[str, SparkSession] = {}
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in a local session without one (tests) an own.

    On a cluster a folder of one machine would lose results, so there the
    setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lexispark-"))
    return _own[0]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder or file, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def open_folder(uri: str) -> Iterator[pa.NativeFile]:
    """The Parquet files of a folder, in the order of their names."""
    fs, root = filesystem(uri)
    for path in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")):
        with fs.open_input_file(path) as f:
            yield f


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/lexispark-{kind}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        _made.pop(path, None)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


@atexit.register
def _cleanup() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


def table(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lexispark_path = path
    return out


def drop_table(df: DataFrame) -> None:
    remove(df.sparkSession, df.lexispark_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, total_bytes: float, each: int = 64 << 20) -> int:
    """At least the session's setting; more when a part would exceed ``each`` bytes."""
    return max(shuffle_partitions(spark), math.ceil(total_bytes / each))


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes are within the limit.

    Strings and binaries are summed; every row counts ``ROW_BYTES`` besides.  A
    table of fixed-width columns needs its ``rows`` alone, if they are known.
    """
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if wide or rows is None:
        length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(ROW_BYTES)).cast("long")
        size = df.agg(F.sum(length).alias("b")).first()["b"] or 0
    else:
        size = rows * ROW_BYTES
    return F.broadcast(df) if size <= limit else df


def null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
