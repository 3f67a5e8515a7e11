"""A stream of documents into the raw tables of an index.

Weights depend on the whole corpus, so the stream only appends what doesn't:
term frequencies and field lengths.  ``open_index`` weighs what has arrived.
Each micro-batch writes a folder of its own number, so one that is repeated
after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.build import Index, IndexBuilder, _Build, weighed


def append_stream(docs: DataFrame, builder: IndexBuilder, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query that appends each micro-batch's counts under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        _Build(builder, batch, True).counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def open_index(spark: SparkSession, builder: IndexBuilder, path: str) -> Index:
    """The index of all documents appended so far; their refs must be unique."""
    return weighed(builder, spark.read.parquet(path).drop("batch"))
