"""Token-id files: Parquet list columns in key order, with selective reads.

Texts are encoded where they are read; only ids travel.  The order of (key,
hash of the text) is cut into ranges of about equal bytes of text, by exact
histograms of candidate boundaries (``sharding``), so one exchange puts every
range into one task, which writes one file, and texts that share a key don't
meet in one.  Keys that aren't integers are ranged by Spark's own sampling; then
the texts travel.

Format: per document ``key``, ``start`` (ids before it in its file),
``n_tokens`` and ``ids`` (list of uint32).  Keys, starts and lengths are
delta encoded; ids are delta encoded integers under Zstandard; row groups
end at ``GROUP_TOKENS`` ids or ``GROUP_ROWS`` documents.  ``token_index`` reads
metadata without ids; ``read_documents`` reads the ids of a few keys, skipping
row groups by their statistics and pages by the page indexes.

A task writes to a name of its own and reports it only when the file is
complete, so a lost or repeated task leaves no half file in the result.

Nulls count as empty texts (the end id alone).  Null keys come last; rows of
equal key follow each other in an order of their own.  Very long texts are
encoded whole.  Only the key and the text are read; other columns are ignored,
whatever their names.  An empty table gives no files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import drop_table, filesystem, new_path, partitions_for, table
from .kernels import buffers
from .sharding import placed, splitters

GROUP_ROWS = 4096
GROUP_TOKENS = 1 << 21
#: Bytes of text whose ids make a file, about.
FILE_TEXT = 256 << 20

FILE_SCHEMA = "part int, file string, n_rows long, n_tokens long"


def _file_schema(key_type: pa.DataType) -> pa.Schema:
    return pa.schema([("key", key_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.uint32())))])


class _Writer:
    """One file; row groups of bounded rows and ids."""

    def __init__(self, folder: str, part: int, key_type: pa.DataType):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root)
        self.path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.parquet"
        self.file = f"{folder}/{os.path.basename(self.path)}"
        self.part, self.schema = part, _file_schema(key_type)
        self.sink = self.fs.open_output_stream(self.path)
        self.writer = pq.ParquetWriter(
            self.sink,
            self.schema,
            compression="zstd",
            compression_level=1,
            use_dictionary=False,
            column_encoding={"key": "DELTA_BINARY_PACKED" if pa.types.is_integer(key_type) else "PLAIN", "start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "ids.list.element": "DELTA_BINARY_PACKED"},
            write_page_index=True,
            data_page_size=256 << 10,
            write_statistics=["key", "start", "n_tokens"],
        )
        self.rows: list[tuple] = []
        self.held = self.total = self.count = 0

    def add(self, key, ids: bytes) -> None:
        self.rows.append((key, ids))
        self.held += len(ids) // 4
        if len(self.rows) >= GROUP_ROWS or self.held >= GROUP_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        sizes = np.array([len(b) // 4 for _, b in self.rows], dtype=np.int64)
        ends = np.cumsum(sizes)
        flat = pa.Array.from_buffers(pa.uint32(), int(ends[-1]), [None, pa.py_buffer(b"".join(b for _, b in self.rows))])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in self.rows], self.schema.field(0).type), pa.array(self.total + ends - sizes), pa.array(sizes), lists.cast(self.schema.field(3).type)], schema=self.schema)
        self.writer.write_batch(batch, row_group_size=GROUP_ROWS)
        self.total += int(ends[-1])
        self.count += len(self.rows)
        self.rows, self.held = [], 0

    def close(self) -> tuple:
        self.flush()
        self.writer.close()
        self.sink.close()
        return self.part, self.file, self.count, self.total


def write_token_files(df: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = 2) -> DataFrame:
    """Encodes every whole text and writes the files; returns what was written.

    The result (part, file, n_rows, n_tokens) is itself a table in the shared
    folder, in the order of the keys by ``part``.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "tokens")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    key_type = df.schema[key].dataType
    # two bytes an id where the vocabulary allows, for a smaller exchange
    narrow = max(words.vocabulary_size(path), end_id or 0) <= 1 << 16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = words.word_table(path, "ids") if words.splits_at_space(path) else None
        get = table_.__getitem__ if table_ is not None else None
        tok = words.load(path)
        for batch in batches:
            buf, off = buffers(batch.column(2))
            raw, off = buf.tobytes(), off.tolist()
            parts = batch.column(0) if place is None else pa.array(place(batch.column(3), batch.column(0).to_numpy()), pa.int32())
            done = 0
            while done < batch.num_rows:
                out, size, first = [], 0, done
                while done < batch.num_rows and size < 8 << 20:
                    t = raw[off[done] : off[done + 1]]
                    if get is not None:
                        ids = b"".join(map(get, t.split())) + end
                    else:
                        ids = np.array(tok.encode(t.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes() + end
                    if narrow:
                        ids = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
                    out.append(ids)
                    size += len(ids)
                    done += 1
                yield pa.RecordBatch.from_arrays([parts.slice(first, done - first), batch.column(1).slice(first, done - first), pa.array(out, pa.binary())], names=["part", "key", "ids"])

    place = None
    row = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", key_type), T.StructField("ids", T.BinaryType())])
    own = F.col(key)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    x, d = own.cast("long"), F.xxhash64(text)
    if isinstance(key_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        rows = table(df.select(x.alias("hash"), d.alias("d"), size.alias("size")), "sizes")
        some, none = rows.where("hash is not null"), rows.where("hash is null")
        n_some, n_none = (partitions_for(spark, t.agg(F.sum("size")).first()[0] or 0, FILE_TEXT) for t in (some, none))
        n_none = n_none if none.limit(1).count() else 0
        # of texts that share a key, too, no file gets more than its part
        cuts, _ = splitters(some, n_some, n_some, 0.02, 0.1)
        drop_table(rows)
        among = placed(cuts)

        def place(keys: pa.Array, d: np.ndarray) -> np.ndarray:
            at = among(keys.fill_null(0).to_numpy(), d)
            return np.where(keys.is_null(), len(cuts) + 1 + d % n_none, at) if n_none else at

        # the range is found where the text is encoded: one worker does both
        encoded = df.select(d.alias("part"), own.alias("key"), F.col(text).alias("text"), x.alias("x")).mapInArrow(encode, row)
        ranged = encoded.repartitionById(len(cuts) + 1 + n_none, F.col("part"))
    else:
        n_parts = partitions_for(spark, df.agg(F.sum(size)).first()[0] or 0, FILE_TEXT)
        ranged = df.select(own.alias("key"), F.col(text).alias("text")).repartitionByRange(n_parts, F.col("key").asc_nulls_last(), F.xxhash64("text"))
        ranged = ranged.select(F.spark_partition_id().alias("part"), "key", "text").mapInArrow(encode, row)
    ordered = ranged.sortWithinPartitions(F.col("part"), F.col("key").asc_nulls_last(), F.col("ids"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, said = None, []
        for batch in batches:
            parts, keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for p, k, b in zip(parts, keys, (x.as_py() for x in ids)):
                if narrow:
                    b = np.frombuffer(b, dtype="<u2").astype("<u4").tobytes()
                if w is None or w.part != p:
                    if w is not None:
                        said.append(w.close())
                    w = _Writer(folder, p, batch.column(1).type)
                w.add(k, b)
        if w is not None:
            said.append(w.close())
        if said:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*said), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "n_rows", "n_tokens"])

    return table(ordered.mapInArrow(write, FILE_SCHEMA), "token-files")


def read_ids(file: str, columns: list[str], rows: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Chosen columns, and row groups if given, of one file."""
    fs, path = filesystem(file)
    with fs.open_input_file(path) as f:
        pf = pq.ParquetFile(f)
        for g in rows if rows is not None else range(pf.num_row_groups):
            yield from pf.iter_batches(batch_size=GROUP_ROWS, row_groups=[g], columns=columns)


def read_token_digests(files: DataFrame, key: str = "doc_id", key_type: T.DataType | None = None) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it over all files: the
    files' totals (one row a file) are accumulated over their order.
    """
    key_type = key_type or T.LongType()
    listed = files.select("part", "file", "n_tokens").collect()  # one row a file, not data
    listed.sort(key=lambda r: r["part"])
    base, rows = 0, []
    for r in listed:
        rows.append((r["file"], base))
        base += r["n_tokens"]
    spark = files.sparkSession
    todo = spark.createDataFrame(rows, "file string, base long")
    todo = todo.repartition(max(1, len(rows)), "file") if rows else todo

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for got in read_ids(file, ["key", "start", "n_tokens", "ids"]):
                    lists = got.column(3)
                    off = lists.offsets.to_numpy()
                    raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                    starts = got.column(1).to_numpy() + before
                    yield pa.RecordBatch.from_arrays([got.column(0), pa.array(starts), got.column(2), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField(key, key_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return todo.mapInArrow(read, schema)


def read_documents(spark: SparkSession, files: DataFrame, keys: list) -> DataFrame:
    """(key, n_tokens, ids) of the given keys: a filter that the scan applies to row groups and pages."""
    paths = [r["file"] for r in files.select("file").collect()]
    return spark.read.parquet(*paths).where(F.col("key").isin(keys)).select("key", "n_tokens", "ids")


def token_index(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Metadata alone (key, start, n_tokens): the ids' column chunks aren't read."""
    paths = [r["file"] for r in files.select("file").collect()]
    return spark.read.parquet(*paths).select("key", "start", "n_tokens")
