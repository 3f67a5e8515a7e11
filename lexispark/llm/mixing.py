"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its key; a source's mix is its documents whose
hash is at most a threshold, once more than the whole passes over the source
that its target holds.  Thresholds come from histograms: sizes are summed by
source and the leading bits of the hash (each task first adds up its own),
the bucket in which the budget runs out is found, and only that bucket is
summed again by its next bits, down to one hash.  Nothing is sorted, and the
thresholds of smaller budgets are nested in those of larger ones.

The boundary document is taken if that brings the source nearer to its
target, so a source misses it by half a document at most (rows of equal key
have equal hashes and are taken together).

Null texts have size 0; a null source is a source of its own, the last; null
keys share one hash.  Very long texts are counted whole.  Repeated rows are
taken together; other columns are passed on or ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, table

#: Bits of the hash per level, and levels: 60 bits in all.
LEVEL_BITS = 12
LEVELS = 5
#: Sources up to which one task ranks them; more are ranked in parallel.
RANKED_ROWS = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def key_hash(key: str) -> Column:
    """60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame, n: int) -> DataFrame:
    """Sources with their 0-based rank by code point, null last."""
    order = [F.col("source").asc_nulls_last()]
    if n <= RANKED_ROWS:
        return sources.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    at = sources.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return sources.sparkSession.createDataFrame(at, sources.schema.add("rank", "long"))


def source_targets(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target): shares by weight, none above ``most`` times its size."""
    spark = docs.sparkSession
    sized = table(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n, total = sized.agg(F.count("*"), F.sum("source_size")).first()
    listed = F.array(*[F.lit(int(w)) for w in weights])
    weighed = table(_ranked(sized, n).withColumn("weight", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int"))), "weights")
    budget = share * (total or 0)
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > most * F.col("source_size")
        capped, free = weighed.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        now = (budget - most * (capped or 0)) / free if free else level
        if now == level:
            break
        level = now
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")).alias("target"))


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, threshold): hash at most threshold is taken once more.

    ``docs`` has source, size and h.  Each level reads the narrow table once
    and sums it by source and bucket, map-side first.
    """
    plan = table(
        targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("path", F.lit(0).cast("long"))
        .withColumn("before", F.lit(0).cast("long"))
        .withColumn("threshold", F.lit(None).cast("long")),
        "plan",
    )
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        todo = plan.where("threshold is null").select(F.col("source").alias("s"), "path")
        inside = docs.where("size > 0").join(small_side(todo), F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("path")), "left_semi")
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"))
        # at most 2 ** LEVEL_BITS rows a source
        w = Window.partitionBy("source").orderBy("bucket")
        cum = sums.withColumn("upto", F.sum("size").over(w))
        cum = cum.select(F.col("source").alias("s"), "bucket", "size", "first", "last", "upto")
        held = plan.where("threshold is null").join(cum, F.col("s").eqNullSafe(F.col("source")) & (F.col("before") + F.col("upto") > F.col("budget")), "left")
        edge = held.groupBy("source").agg(F.min(F.struct("bucket", "size", "first", "last", "upto")).alias("e"))
        now = plan.join(edge.select(F.col("source").alias("s"), "e"), F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
        before = F.col("before") + F.col("e.upto") - F.col("e.size")
        half = 2 * (F.col("budget") - before) >= F.col("e.size")
        settled = F.col("threshold").isNotNull()
        one = F.col("e.first") == F.col("e.last")
        plan = table(
            now.select(
                "source",
                "source_size",
                "target",
                "passes",
                "budget",
                F.when(settled, F.col("path")).otherwise(F.coalesce("e.bucket", F.lit(0).cast("long"))).alias("path"),
                F.when(settled, F.col("before")).otherwise(F.coalesce(before, F.col("before"))).alias("before"),
                F.when(settled, F.col("threshold"))
                .when(F.col("e.bucket").isNull(), F.lit((1 << 62)))  # the budget holds all that is left
                .when(one & half, F.col("e.first"))
                .when(one, F.col("e.first") - 1)
                .alias("threshold"),
            ),
            "plan",
        )
        if not plan.where("threshold is null").limit(1).count():
            break
    return plan.select("source", "source_size", "target", "passes", "threshold")


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, h): all that mixing needs of a document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size.alias("size"), key_hash(key).alias("h"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(key, size, source_size, target, taken) of every row."""
    docs = table(measured(df, key, text, source), "sizes")
    plan = thresholds(docs, source_targets(docs, weights, share, most))
    out = docs.join(small_side(plan.withColumnRenamed("source", "s")), F.col("s").eqNullSafe(F.col("source")))
    copies = F.col("passes") + F.when((F.col("h") <= F.col("threshold")) & (F.col("passes") < most), 1).otherwise(0)
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them; those without words once a pass."""
    docs = table(measured(df, key, text, source), "sizes")
    plan = thresholds(docs, source_targets(docs, weights, share, most))
    side = plan.select(F.col("source").alias("__lx_source"), F.col("passes").alias("__lx_passes"), F.col("threshold").alias("__lx_threshold"))
    out = df.withColumn("__lx_h", key_hash(key)).join(small_side(side), F.col("__lx_source").eqNullSafe(F.col(source).cast("string")))
    copies = F.col("__lx_passes") + F.when((F.col("__lx_h") <= F.col("__lx_threshold")) & (F.col("__lx_passes") < most), 1).otherwise(0)
    return out.withColumn("__lx_n", copies.cast("int")).where("__lx_n > 0").withColumn("__lx_copy", F.explode(F.sequence(F.lit(1), F.col("__lx_n")))).select(*df.columns)
