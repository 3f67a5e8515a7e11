"""Term weights, and sparse vectors held as maps from term index to weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + F.abs((n_docs - df + 0.5) / (df + 0.5)))


def bm25_weight(idf_: Column, tf: Column, length: Column, average: Column, k1: float, b: float, field_boost: Column, doc_boost: Column) -> Column:
    """Weight of a term in a field, rounded half away from zero to three decimals."""
    k, bb = F.lit(float(k1)), F.lit(float(b))
    raw = idf_ * ((k + 1) * tf) / (k * (1 - bb + bb * (length / average)) + tf)
    return F.round(raw * field_boost * doc_boost * 1000) / 1000


def vector(indices: Column, weights: Column) -> Column:
    """A sparse vector of two arrays; an index that occurs twice is an error."""
    return F.map_from_arrays(indices, weights)


def upsert(v: Column, index: Column, weight: Column, add: bool = True) -> Column:
    """``v`` with a weight set, or added to what is there."""
    one = F.map_from_arrays(F.array(index), F.array(weight))
    return F.map_zip_with(v, one, lambda k, a, b: F.when(b.isNull(), a).otherwise(F.when(a.isNull() | F.lit(not add), b).otherwise(a + b)))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(v), F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda acc, x: acc + x)


def similarity(query: Column, field: Column) -> Column:
    """Dot product over the query's length alone; 0 for an empty query."""
    m = magnitude(query)
    return F.when(m == 0, F.lit(0.0)).otherwise(dot(query, field) / m)


def to_flat(v: Column) -> Column:
    """[index, weight, index, weight, ...] by rising index."""
    entries = F.array_sort(F.map_entries(v))
    return F.flatten(F.transform(entries, lambda e: F.array(e["key"].cast("double"), e["value"])))


def from_flat(flat: Column) -> Column:
    """The inverse; an element without a partner at the end is dropped."""
    n = F.floor(F.size(flat) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.map_from_arrays(F.transform(at, lambda k: F.get(flat, 2 * k).cast("long")), F.transform(at, lambda k: F.get(flat, 2 * k + 1)))
