"""Query execution: one relational plan for one query or for many.

Clauses are rows.  Their terms, after the language's own expressions, are
expanded against the vocabulary: by a filtered read of it where few words fit,
so that the postings are read under filters on terms, else by joins.  They meet
the postings in one join on (field, term), and one aggregation by document
gives the scores of all fields and the tests of presence together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import Language, explode_tokens
from ..plans.parser import parse_query
from ..plans.query import Presence, Query
from .build import Index

_CLAUSE = "query_id string, clause_no int, presence string, boost double, edits int, term string, fields array<string>"


def _queries(index: Index, queries: Mapping) -> dict[str, Query]:
    return {str(k): parse_query(q, index.fields, index.language.query_separators) if isinstance(q, str) else q for k, q in queries.items()}


def _alignments(pattern: str, term: str) -> int:
    """How many ways the pattern's stars share out the term, as a walk of a trie counts them:
    a star is passed without a character, or takes one and stays."""
    ways = [1] + [0] * len(term)
    for ch in pattern:
        if ch == "*":
            for k in range(1, len(term) + 1):
                ways[k] += ways[k - 1]
        else:
            ways = [0] + [ways[k] if term[k] == ch else 0 for k in range(len(term))]
    return ways[len(term)]


#: Words of queries that went through a language's expressions before: (language, term) to words.
_known: dict[tuple[Language, str], tuple[str, ...]] = {}

#: Terms that patterns may expand to at the driver, and rows of what is asked; beyond, the
#: vocabulary is joined.
EXPANDED, ASKED = 10_000, 50_000


def _words(index: Index, terms: set[str]) -> dict[str, tuple[str, ...]]:
    """The words that a query's terms become by trimming and stemming: those of the index's
    own expressions, over a table of the new terms only."""
    language = index.language
    new = sorted(t for t in terms if (language, t) not in _known)
    if new:
        if len(_known) > 100_000:
            _known.clear()
        df = index.postings.sparkSession.createDataFrame([(t, t) for t in new], "term string, text string")
        tokens = explode_tokens(df, language, "text", ["term"]).where("raw is not null")
        trimmed = tokens.select("term", "ord", language.trim(F.col("raw")).alias("word")).where("word <> ''")
        got: dict[str, list] = {t: [] for t in new}
        for r in language.stemmed(trimmed, "word").collect():
            got[r["term"]].append((tuple(r["ord"]), r["word"]))
        for t, own in got.items():
            _known[language, t] = tuple(w for _, w in sorted(own))
    return {t: _known[language, t] for t in terms}


def _expanded(index: Index, terms: DataFrame, kinds: set[str]) -> DataFrame:
    """Terms with the words of the vocabulary they stand for (``word``, null if
    none) and how often (``times``)."""
    vocab = index.vocab.select(F.col("term").alias("word"))
    cols = [c for c in terms.columns]
    parts = []
    if "exact" in kinds:
        exact = terms.where((~F.col("term").contains("*")) & F.coalesce(F.col("edits") == 0, F.lit(True)))
        found = vocab.join(F.broadcast(exact.select("term").distinct()), F.col("word") == F.col("term"), "left_semi")
        parts.append(exact.join(F.broadcast(found), F.col("word") == F.col("term"), "left").select(*cols, "word", F.lit(1).alias("times")))
    if "wild" in kinds:
        pattern = F.replace(F.regexp_replace("term", r"([%_\\])", r"\\$1"), F.lit("*"), F.lit("%"))
        wild = terms.where(F.col("term").contains("*")).withColumn("_like", pattern)
        hits = vocab.join(F.broadcast(wild), F.expr("word LIKE _like"))
        if "stars" in kinds:

            @F.pandas_udf("int")
            def times(term, word):
                import pandas as pd

                return pd.Series([_alignments(t, w) for t, w in zip(term, word)], dtype="int32")

            hits = hits.withColumn("times", times("term", "word"))
        else:
            hits = hits.withColumn("times", F.lit(1))
        hits = hits.select("query_id", "clause_no", "term", "word", "times")
        parts.append(wild.drop("_like").join(hits, ["query_id", "clause_no", "term"], "left").select(*cols, "word", "times"))
    if "fuzzy" in kinds:
        fuzzy = terms.where((~F.col("term").contains("*")) & (F.col("edits") > 0))
        near = (F.abs(F.length("word") - F.length("term")) <= F.col("edits")) & (F.expr("levenshtein(word, term, edits)") >= 0)
        hits = vocab.join(F.broadcast(fuzzy.select("query_id", "clause_no", "term", "edits")), near).select("query_id", "clause_no", "term", "word").distinct()
        parts.append(fuzzy.join(hits, ["query_id", "clause_no", "term"], "left").select(*cols, "word", F.lit(1).alias("times")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _kinds(queries: Mapping[str, Query]) -> set[str]:
    kinds = set()
    for q in queries.values():
        for c in q.clauses:
            if "*" in c.term:
                kinds |= {"wild"} | ({"stars"} if c.term.count("*") > 1 else set())
            elif c.edit_distance:
                kinds.add("fuzzy")
            else:
                kinds.add("exact")
    return kinds


def _literals(index: Index, rows: list[tuple]) -> list[tuple[tuple, str | None, int]] | None:
    """Each row of a clause with each word of the vocabulary it stands for and how often (None, 0
    if none); None if those are too many for the driver.

    The vocabulary is read once, under filters that its sorted files can skip by.
    """
    term = F.col("term")
    exact = sorted({r[5] for r in rows if "*" not in r[5] and not r[4]})
    wild = sorted({r[5] for r in rows if "*" in r[5]})
    fuzzy = sorted({(r[5], r[4]) for r in rows if "*" not in r[5] and r[4]})
    if len(wild) + len(fuzzy) > 100:
        return None
    tests = [term.isin(exact)] if exact else []
    for p in wild:
        like = term.like(re.sub(r"([%_\\])", r"\\\1", p).replace("*", "%"))
        head = p.split("*", 1)[0]
        tests.append(F.startswith(term, F.lit(head)) & like if head else like)
    near = [(F.abs(F.length(term) - len(t)) <= n) & (F.levenshtein(term, F.lit(t), n) >= 0) for t, n in fuzzy]
    flags = [x.alias(f"near{k}") for k, x in enumerate(near)]
    limit = len(exact) + (EXPANDED if wild or fuzzy else 0)
    got = index.vocab.where(reduce(or_, tests + near)).select("term", *flags).limit(limit + 1).collect() if rows else []
    if len(got) > limit:
        return None
    words = {r["term"] for r in got}
    close = {f: [r["term"] for r in got if r[f"near{k}"]] for k, f in enumerate(fuzzy)}
    fits = {p: [(w, n) for w in words for n in [_alignments(p, w)] if n] for p in wild}
    out = []
    for r in rows:
        t, edits = r[5], r[4]
        found = fits[t] if "*" in t else [(w, 1) for w in close[t, edits]] if edits else [(t, 1)] if t in words else []
        out += [(r, w, n) for w, n in found] or [(r, None, 0)]
    return out


_ASKED = "query_id string, clause_no int, presence string, field string, term string, boost double, times int, norm double, need int"


def _asked(index: Index, queries: Mapping[str, Query]) -> tuple[DataFrame, tuple[list, list] | None]:
    """What is asked of the postings: (query_id, clause_no, presence, field, term, boost, times,
    norm, need); and its fields and terms, if they are few.

    ``norm`` is the length of the query's vector in the field, ``need`` how many required
    clauses a document must meet; -1 if the query only excludes, or can't be met.
    """
    spark = index.postings.sparkSession
    words = _words(index, {c.term for q in queries.values() for c in q.clauses if c.use_pipeline})
    rows = [
        (k, n, c.presence.value, float(c.boost), c.edit_distance, w, list(c.fields))
        for k, q in queries.items()
        for n, c in enumerate(q.clauses)
        for w in (words[c.term] if c.use_pipeline else (c.term,))
    ]
    need = {k: -1 if q.is_negated else sum(c.presence is Presence.REQUIRED for c in q.clauses) for k, q in queries.items()}
    hits = _literals(index, rows)
    if hits is not None:
        for r, w, _ in hits:
            if w is None and r[2] == Presence.REQUIRED.value:
                need[r[0]] = -1
        asked = [(r[0], r[1], r[2], f, w, r[3] * n, n) for r, w, n in hits if w is not None for f in r[6]]
        if len(asked) <= ASKED:
            vectors: dict[tuple, dict[str, float]] = {}
            for k, _, _, f, w, x, _ in asked:
                own = vectors.setdefault((k, f), {})
                own[w] = own.get(w, 0.0) + x
            norms = {key: math.sqrt(sum(x * x for x in own.values())) for key, own in vectors.items()}
            return spark.createDataFrame([(*a, norms[a[0], a[3]], need[a[0]]) for a in asked], _ASKED), (sorted({a[3] for a in asked}), sorted({a[4] for a in asked}))
    kinds = _kinds(queries)
    found = _expanded(index, spark.createDataFrame(rows, _CLAUSE), kinds or {"exact"})
    hollow = found.where((F.col("presence") == Presence.REQUIRED.value) & F.col("word").isNull()).select("query_id").distinct().withColumn("hollow", F.lit(True))
    hit = found.where(F.col("word").isNotNull())
    asked = hit.select("query_id", "clause_no", "presence", F.explode("fields").alias("field"), F.col("word").alias("term"), (F.col("boost") * F.col("times")).alias("boost"), "times")
    lengths = asked.groupBy("query_id", "field", "term").agg(F.sum("boost").alias("w")).groupBy("query_id", "field").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    needs = spark.createDataFrame(list(need.items()), "query_id string, need int")
    # a row a query, or a query and field
    asked = asked.join(F.broadcast(lengths), ["query_id", "field"]).join(F.broadcast(needs), "query_id").join(F.broadcast(hollow), "query_id", "left")
    return asked.withColumn("need", F.when(F.col("hollow"), -1).otherwise(F.col("need"))).drop("hollow"), None


def _met(index: Index, asked: DataFrame, keys: tuple[list, list] | None, columns: list[str]) -> DataFrame:
    """Postings of what is asked.  Known terms become filters, which prune fields' folders and terms' row groups."""
    postings = index.postings
    if keys is not None:
        fields, terms = keys
        postings = postings.where(F.col("field").isin(fields) & F.col("term").isin(terms)) if terms else postings.limit(0)
        asked = F.broadcast(asked)
    return postings.select("term", "field", "doc_ref", *columns).join(asked, ["field", "term"])


def _plan(index: Index, queries: Mapping[str, Query]) -> tuple[DataFrame, DataFrame, tuple[list, list] | None]:
    """(query_id, ref, score), what is asked of fields that count, and its fields and terms, if few."""
    asked, keys = _asked(index, queries)
    met = _met(index, asked, keys, ["weight"])
    banned = F.col("presence") == Presence.PROHIBITED.value
    # all fields in one aggregation, map-side first
    sums, scores = [], []
    for n, f in enumerate(index.fields):
        own = F.col("field") == f
        sums += [F.sum(F.when(own, F.col("boost") * F.col("weight"))).alias(f"dot{n}"), F.max(F.when(own, F.col("norm"))).alias(f"norm{n}"), F.max(own & ~banned).alias(f"wanted{n}")]
        score = F.col(f"dot{n}") / F.col(f"norm{n}")
        scores.append(F.when(F.col(f"wanted{n}") & (score != 0), score))
    required = F.when(F.col("presence") == Presence.REQUIRED.value, F.col("clause_no"))
    by_doc = met.groupBy("query_id", "doc_ref").agg(*sums, F.max(banned).alias("banned"), F.max("need").alias("need"), F.size(F.collect_set(required)).alias("required"))
    good = by_doc.where(~F.col("banned") & (F.col("required") == F.col("need")) & F.coalesce(*scores).isNotNull())
    total = reduce(add, [F.coalesce(x, F.lit(0.0)) for x in scores], F.lit(0.0))
    result = good.select("query_id", F.col("doc_ref").alias("ref"), total.alias("score"))
    negated = [k for k, q in queries.items() if q.is_negated]
    if negated:
        docs = index.doc_fields.where("length > 0").select("doc_ref").distinct()
        every = docs.select(F.explode(F.array(*[F.lit(k) for k in negated])).alias("query_id"), "doc_ref")
        free = every.join(by_doc.where("banned").select("query_id", "doc_ref"), ["query_id", "doc_ref"], "left_anti")
        result = result.unionByName(free.select("query_id", F.col("doc_ref").alias("ref"), F.lit(0.0).alias("score")))
    return result, asked.where(F.col("presence") != Presence.PROHIBITED.value), keys


def search(index: Index, query: str | Query, limit: int | None = None, matches: bool = False) -> DataFrame:
    """(ref, score[, terms]) by falling score, then ref; all results unless limited.

    ``terms`` maps term to field to positions; only the postings of returned
    documents are read for it.
    """
    parsed = _queries(index, {"0": query})
    result, asked, keys = _plan(index, parsed)
    out = result.select("ref", "score").orderBy(F.desc("score"), "ref")
    if limit is not None:
        out = out.limit(limit)
    if not matches:
        return out
    spots = _met(index, asked, keys, ["weight", "positions"]).join(out.withColumnRenamed("ref", "doc_ref"), "doc_ref")
    spots = spots.where("score <> 0")
    each = F.struct("clause_no", F.flatten(F.array_repeat("positions", F.col("times"))).alias("positions"))
    own = spots.groupBy("doc_ref", "term", "field").agg(F.flatten(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["positions"])).alias("positions"), F.sum(F.col("boost") * F.col("weight")).alias("x"))
    # a field that adds nothing to the score shows no matches
    own = own.withColumn("x", F.sum("x").over(Window.partitionBy("doc_ref", "field"))).where("x <> 0")
    by_term = own.groupBy("doc_ref", "term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "positions")), lambda a, b: F.when(a["field"] < b["field"], -1).when(a["field"] > b["field"], 1).otherwise(0))).alias("fields"))
    by_doc = by_term.groupBy(F.col("doc_ref").alias("ref")).agg(F.map_from_entries(F.collect_list(F.struct("term", "fields"))).alias("terms"))
    return out.join(by_doc, "ref", "left").orderBy(F.desc("score"), "ref")


def search_many(index: Index, queries: Mapping, k: int | None = None) -> DataFrame:
    """(query_id, rank, ref, score) of all queries, the best ``k`` of each or all."""
    result, _, _ = _plan(index, _queries(index, queries))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref")
    out = result.withColumn("rank", F.row_number().over(w))
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out.select("query_id", "rank", "ref", "score")
