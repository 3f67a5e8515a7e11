"""A corpus from raw documents to token ids: five stages, each a full pass.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage
before it kept, and returns the columns of ``documents`` (the last: what the
encoding yields).  Between stages the rows are written to the shared folder
and read again, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import drop_table, small_side, table


_ROW = "lexispark_row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    from lexispark.llm.quality import quality_filter

    return quality_filter(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the least doc_id, null being the largest.

    Every row is a document of its own, numbered here, also where doc_ids are
    shared or null; of rows with a group's least doc_id the first stays.
    """
    from lexispark.llm.ngram_join import ngram_join

    numbered = table(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    found = table(ngram_join(numbered, _ROW).where("n_similar > 0").select(_ROW, "component_id"), "near-copies")
    keyed = numbered.select(_ROW, "doc_id").join(small_side(found, found.count()), _ROW)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _ROW))
    stay = keyed.groupBy("component_id").agg(least.alias("least")).select(F.col(f"least.{_ROW}").alias(_ROW))
    gone = table(found.select(_ROW).join(stay, _ROW, "left_anti"), "gone")
    return numbered.join(small_side(gone, gone.count()), _ROW, "left_anti").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of strings of 200 bytes that start more than once."""
    from lexispark.llm.suffix_dedup import remove_repeats

    return remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their shares."""
    from lexispark.llm.mixing import mixed_rows

    return mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import public_tokenizers

    from lexispark.llm.bpe import make_lexicon, round_trip

    path = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(docs, path, lexicon=make_lexicon(docs, path))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Distances, suffix arrays and token merges aren't SQL; the tests hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "stage")
        if last is not None:
            drop_table(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
