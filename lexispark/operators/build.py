"""Index construction: documents to postings, vocabulary and field lengths.

One exchange of whole texts by document serves token starts, term frequencies and
field lengths: each task counts its documents in Arrow batches (``counting``), and
its rows are staged by term.  Document frequencies are counted from these; weights
are made where postings are read, so that postings are never exchanged for them.

Languages that redefine what ``Language`` does are counted by their own column
expressions: the vocabulary comes first, and every distinct word is trimmed and
stemmed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import _BLANKS, ENGLISH, Language, explode_tokens, raw_words
from ..functions.weights import bm25_weight, idf
from ..functions.words import alphabet, plain
from ..sources.staging import new_folder, staged
from .counting import COUNTED, counting, writing

#: Bytes of a vocabulary up to which all of it is broadcast.
VOCABULARY_BYTES = 32 << 20

_SPOT = "start:int,length:int"


@dataclass
class Index:
    """Tables of an index.

    ``postings`` (term, field, doc_ref, tf, weight, positions), ``vocab``
    (term, df), ``doc_fields`` (doc_ref, field, length), ``counts``: postings
    without weights, which need no join.
    """

    postings: DataFrame
    vocab: DataFrame
    doc_fields: DataFrame
    fields: tuple[str, ...]
    language: Language
    field_stats: DataFrame | None = None
    counts: DataFrame | None = None

    def search(self, query: str, limit: int | None = None, matches: bool = False) -> DataFrame:
        """(ref, score[, terms]) of a query string, best first."""
        from .search import search

        return search(self, query, limit, matches)

    def query(self, query, limit: int | None = None, matches: bool = False) -> DataFrame:
        """The same of a ``Query``."""
        from .search import search

        return search(self, query, limit, matches)

    def search_many(self, queries: dict, k: int | None = None) -> DataFrame:
        """(query_id, rank, ref, score) of many queries in one plan."""
        from .search import search_many

        return search_many(self, queries, k)

    def cache(self) -> "Index":
        for t in (self.postings, self.vocab, self.doc_fields):
            t.persist()
        return self

    def unpersist(self) -> None:
        for t in (self.postings, self.vocab, self.doc_fields):
            t.unpersist()


@dataclass
class IndexBuilder:
    """Collects the configuration of an index; ``build`` makes its plan."""

    language: Language = ENGLISH
    k1_: float = 1.2
    b_: float = 0.75
    ref: str = "id"
    boost: str | None = None
    fields: dict[str, float] = field(default_factory=dict)

    def ref_field(self, name: str) -> "IndexBuilder":
        self.ref = name
        return self

    def doc_boost(self, column: str | None) -> "IndexBuilder":
        """Column of a document's boost; null is 1."""
        self.boost = column
        return self

    def field(self, name: str, boost: float = 1.0) -> "IndexBuilder":
        if "/" in name:
            raise ValueError("a field's name can't have a slash")
        if name in self.fields:
            raise ValueError(f"field {name!r} is declared twice")
        self.fields[name] = max(0.0, float(boost))
        return self

    def k1(self, value: float) -> "IndexBuilder":
        self.k1_ = float(value)
        return self

    def b(self, value: float) -> "IndexBuilder":
        self.b_ = min(1.0, max(0.0, float(value)))
        return self

    def build(self, docs: DataFrame, positions: bool = True, spread: bool = False) -> Index:
        """The index of ``docs``, whose refs must be unique.

        Without ``positions`` postings hold null for them, and neither starts
        nor their ordering are computed.  ``spread`` says that ``docs`` are spread
        over partitions by their refs, so that texts needn't be exchanged again.
        """
        return _Build(self, docs, positions, spread).index


class _Build:
    def __init__(self, config: IndexBuilder, docs: DataFrame, positions: bool, spread: bool = False):
        self.config, self.docs, self.positions, self.spread = config, docs, positions, spread

    @cached_property
    def texts(self) -> DataFrame:
        """(doc_ref, doc_boost, field, text): a row per document and field."""
        c = self.config
        boost = F.greatest(F.coalesce(F.col(c.boost).cast("double"), F.lit(1.0)), F.lit(0.0)) if c.boost else F.lit(1.0)
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) if f in self.docs.columns else F.lit(None)).cast("string").alias("text")) for f in c.fields])
        return self.docs.select(F.col(c.ref).cast("string").alias("doc_ref"), boost.alias("doc_boost"), F.explode(pairs).alias("_f")).select("doc_ref", "doc_boost", "_f.field", "_f.text")

    def tokens(self, texts: DataFrame) -> DataFrame:
        """(doc_ref, field, doc_boost, raw[, ord, start, length]) of all tokens; a null ``raw`` for a text without any."""
        language, keys = self.config.language, ["doc_ref", "field"]
        if not self.positions and len(language.parts) == 1 and not language.script:
            # no starts: words by splitting alone
            return texts.select(*keys, "doc_boost", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), rf"[{_BLANKS}-]", -1)).alias("raw"))
        return explode_tokens(texts, language, "text", keys, ("doc_boost",))

    @cached_property
    def vocabulary(self) -> tuple[DataFrame, bool]:
        """(raw, term) of raw words, small enough to be broadcast, and whether these are all.

        Every distinct word is trimmed and stemmed once; a null term is left out of the index.
        Of a vocabulary beyond ``VOCABULARY_BYTES`` the most frequent words are kept.
        """
        language = self.config.language
        raws = raw_words(self.texts, language, "text").groupBy("raw").agg(F.count("*").alias("n"))
        words = staged(language.stemmed(raws.select("raw", "n", *_terms(language, F.col("raw"))), "term"))
        size = (F.octet_length("raw") + F.coalesce(F.octet_length("term"), F.lit(0)) + 48).cast("long")
        total = words.agg(F.sum(size)).first()[0] or 0
        if total <= VOCABULARY_BYTES:
            return words.select("raw", "term"), True
        # a row for each doubling of the count
        bins = words.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.min("n").alias("n"), F.sum(size).alias("size")).collect()
        least, held = None, 0
        for r in sorted(bins, key=lambda r: -r["b"]):
            held += r["size"]
            if held > VOCABULARY_BYTES:
                break
            least = r["n"]
        return words.where(F.col("n") >= least if least is not None else F.lit(False)).select("raw", "term"), False

    @cached_property
    def counted(self) -> DataFrame:
        """(doc_ref, field, doc_boost, term, tf, length, positions); a null term stands once for each
        document's field and counts what was left out."""
        language = self.config.language
        if not plain(language):
            found = staged(self.expressed)
            none = found.groupBy("doc_ref", "field").agg(F.first("doc_boost").alias("doc_boost"), F.sum(F.when(F.col("term").isNull(), F.col("tf")).otherwise(0)).alias("tf"), F.max("length").alias("length"))
            return found.where(F.col("term").isNotNull()).unionByName(none, allowMissingColumns=True)
        return self.whole.mapInArrow(counting(language, alphabet(self.docs.sparkSession), self.positions), COUNTED)

    @property
    def whole(self) -> DataFrame:
        """Lower-cased texts, those of a document together."""
        texts = self.texts.withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
        if not self.spread:
            # by number, as few and uneven parts would leave cores idle
            texts = texts.repartition(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_ref")
        return texts.sortWithinPartitions("doc_ref").select("doc_ref", "field", "doc_boost", "text")

    @cached_property
    def expressed(self) -> DataFrame:
        """The same by the language's column expressions, with a null term only where something was left out."""
        language, keys = self.config.language, ["doc_ref", "field"]
        known, complete = self.vocabulary
        # whole texts are exchanged once, before they become many rows; all that follows stays where it is
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tokens = self.tokens(self.texts.repartition(n, *keys))
        named = tokens.join(F.broadcast(known.withColumn("_known", F.lit(True))), "raw", "left")
        if not complete:  # the others are trimmed and stemmed where they are
            rare = F.when(F.col("_known").isNull(), F.col("raw"))
            named = language.stemmed(named.withColumn("_term", F.col("term")).drop("term").select("*", *_terms(language, rare)), "term")
            named = named.withColumn("term", F.coalesce("_term", "term"))
        spots = F.first(F.lit(None).cast(f"array<struct<ord:int,{_SPOT}>>"))
        # the boost isn't a key: doubles are normalised in keys, which would cost the partitioning
        # tokens are in order of their documents already, which the window relies on
        length = F.count("term").over(Window.partitionBy(*keys))
        first = [F.first(c).alias(c) for c in ("doc_boost", "length")]
        found = named.withColumn("length" if not self.positions else "_length", length)
        if self.positions:
            found = found.withColumnsRenamed({"length": "_size", "_length": "length"})
            spots = F.collect_list(F.struct("ord", "start", F.col("_size").alias("length")))
        found = found.groupBy(*keys, "term").agg(F.count("*").alias("tf"), *first, spots.alias("spots"))
        spots = F.transform(F.array_sort("spots"), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
        return found.select(*keys, "doc_boost", "term", "tf", "length", spots.alias("positions"))

    @cached_property
    def index(self) -> Index:
        language, spark = self.config.language, self.docs.sparkSession
        if not plain(language):
            return weighed(self.config, staged(self.counted))
        # what is counted goes to files past Spark's rows; only document frequencies come back
        at = new_folder(spark)
        found = self.whole.mapInArrow(writing(language, alphabet(spark), self.positions, at), "term string, df long")
        vocab = _by_term(found, F.sum("df"))
        return weighed(self.config, spark.read.schema(COUNTED).parquet(at), vocab)


def _by_term(df: DataFrame, n: Column) -> DataFrame:
    return staged(df.groupBy("term").agg(n.alias("df")).sortWithinPartitions("term"))


def _terms(language: Language, raw: Column) -> list[Column]:
    """``term``: a raw word without marks at its edges; null if it is empty or a stop word."""
    term = language.trim(F.coalesce(raw, F.lit("")))
    return [F.when((term != "") & ~language.is_stop_word(term), term).alias("term")]


def weighed(config: IndexBuilder, counted: DataFrame, vocab: DataFrame | None = None) -> Index:
    """An index from counted terms: lengths, document frequencies and weights."""
    lengths = staged(counted.where(F.col("term").isNull()).select("doc_ref", "field", "length"))
    terms = counted.where(F.col("term").isNotNull())
    vocab = vocab or _by_term(terms, F.count("*"))
    # a row per field: how long it is on average, over all documents
    stats = lengths.groupBy("field").agg(F.sum("length").alias("total"), F.count("*").alias("n_docs"))
    stats = stats.select("field", "n_docs", (F.col("total") / F.col("n_docs")).alias("average"))
    known = {r["field"]: r for r in stats.collect()}

    def of(value: Callable[[str], float | None]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for f in config.fields for x in (f, value(f))]), F.col("field"))

    n_docs, average = (of(lambda f, c=c, none=none: known[f][c] if f in known else none) for c, none in (("n_docs", 0), ("average", 0.0)))
    weight = bm25_weight(idf(n_docs, F.col("df")), F.col("tf"), F.col("length"), average, config.k1_, config.b_, of(config.fields.get), F.col("doc_boost"))
    postings = terms.join(vocab, "term").select("term", "field", "doc_ref", "tf", weight.alias("weight"), "positions")
    counts = terms.select("term", "field", "doc_ref", "tf", "positions")
    return Index(postings, vocab, lengths, tuple(config.fields), config.language, stats, counts)
