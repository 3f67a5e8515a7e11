"""Indexes in and out: Parquet tables, and the JSON form.

Parquet is the form for large indexes: postings are partitioned by field and
sorted by term within files, so a search reads the row groups whose ranges
hold its terms.  The JSON form holds one index in one string and is for small
ones; it keeps weights, not the parameters that made them.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import Language, language_from_code
from ..operators.build import Index, IndexBuilder

JSON_VERSION = "0.1.0"
_POSITIONS = "array<struct<start:int,length:int>>"


def save(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Writes an index as tables under ``path``."""
    spark = index.postings.sparkSession
    ranged = index.postings.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    ranged.write.mode(mode).partitionBy("field").parquet(f"{path}/postings")
    index.vocab.sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/vocab")
    index.doc_fields.write.mode(mode).parquet(f"{path}/doc_fields")
    meta = spark.createDataFrame([(list(index.fields), index.language.code)], "fields array<string>, language string")
    meta.coalesce(1).write.mode(mode).json(f"{path}/meta")


def load(spark: SparkSession, path: str, language: str | Language | None = None) -> Index:
    """Reads what ``save`` wrote."""
    meta = spark.read.schema("fields array<string>, language string").json(f"{path}/meta").first()
    lang = _language(meta["language"], language)
    # a schema of its own: names of fields may look like numbers
    postings = spark.read.schema(f"term string, doc_ref string, tf long, weight double, positions {_POSITIONS}, field string").parquet(f"{path}/postings")
    return Index(postings, spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/doc_fields"), tuple(meta["fields"]), lang)


def _language(stored: str, given: str | Language | None) -> Language:
    lang = language_from_code(given or stored) if not isinstance(given, Language) else given
    if lang.code != stored:
        warnings.warn(f"the index was made with language {stored!r}, not {lang.code!r}", stacklevel=3)
    return lang


def to_json(index: Index) -> str:
    """The whole index as one JSON text, at the driver: for small indexes."""
    rows = index.postings.select("term", "field", "doc_ref", "weight", "positions").collect()
    order = {f: k for k, f in enumerate(index.fields)}
    refs = sorted({r["doc_ref"] for r in rows})
    place = {r: k for k, r in enumerate(refs)}
    rows.sort(key=lambda r: (place[r["doc_ref"]], order[r["field"]], [tuple(p) for p in r["positions"] or []], r["term"]))
    number: dict[str, int] = {}
    vectors: dict[str, list] = {}
    postings: dict[str, dict] = {}
    for r in rows:
        n = number.setdefault(r["term"], len(number))
        vectors.setdefault(f"{r['doc_ref']}/{r['field']}", []).append((n, r["weight"]))
        own = postings.setdefault(r["term"], {"_index": n})
        own.setdefault(r["field"], {})[r["doc_ref"]] = {"position": [[p["start"], p["length"]] for p in r["positions"] or []]}
    return json.dumps(
        {
            "version": JSON_VERSION,
            "language": index.language.code,
            "fields": list(index.fields),
            "fieldVectors": [[k, [x for pair in sorted(vectors[k]) for x in (float(pair[0]), pair[1])]] for k in sorted(vectors)],
            "invertedIndex": [[t, postings[t]] for t in sorted(postings, key=lambda t: t.encode("utf-8"))],
            "pipeline": list(index.language.labels),
        },
        ensure_ascii=False,
    )


def from_json(spark: SparkSession, text: str, language: str | Language | None = None) -> Index:
    """An index from its JSON form."""
    j = json.loads(text)
    lang = _language(j.get("language", "en"), language)
    weights: dict[tuple, float] = {}
    for at, flat in j["fieldVectors"]:
        ref, field = at.rsplit("/", 1)
        for n, w in zip(flat[0::2], flat[1::2]):
            weights[ref, field, int(n)] = float(w)
    rows, df = [], {}
    for term, own in j["invertedIndex"]:
        for field, docs in own.items():
            if field == "_index":
                continue
            for ref, meta in docs.items():
                spots = [(int(a), int(b)) for a, b in meta.get("position", [])]
                weight = weights.get((ref, field, own["_index"]))
                if weight is None:
                    raise ValueError(f"no weight of term {term!r} in {ref}/{field}: vectors are named by ref, then field")
                rows.append((term, field, ref, len(spots), weight, spots))
                df[term] = df.get(term, 0) + 1
    postings = spark.createDataFrame(rows, f"term string, field string, doc_ref string, tf long, weight double, positions {_POSITIONS}")
    vocab = spark.createDataFrame(list(df.items()), "term string, df long")
    lengths = postings.groupBy("doc_ref", "field").agg(F.sum("tf").alias("length"))
    return Index(postings, vocab, lengths, tuple(j["fields"]), lang)


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of JSON arrays, or of JSON ``lines`` (which are split over tasks): location, title, text, boost."""
    return spark.read.schema("location string, title string, text string, boost double").option("multiLine", not lines).json(path)


def build_documents(docs: DataFrame, language: str = "en", boost: str = "boost") -> Index:
    """The preset index of documents with location, title and text; both fields weigh 1."""
    missing = docs.where(F.col("location").isNull()).limit(1).count()
    if missing:
        raise ValueError("document missing location")
    builder = IndexBuilder(language_from_code(language)).ref_field("location").field("title").field("text")
    return builder.doc_boost(boost if boost in docs.columns else None).build(docs)


def results_json(results: DataFrame) -> DataFrame:
    """Each result row as one JSON text: {ref, score, terms}."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("result"))
