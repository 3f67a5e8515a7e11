"""The engine's operators as queries over a folder of tables, with their SQL.

The main corpus is ``documents`` with two fields, the first line as a title
and the whole text, and a boost from ``labels``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import weights as W
from .functions.languages import CHINESE, ENGLISH, JAPANESE, KOREAN, STOP_WORDS, explode_tokens, multi
from .functions.stemming import stem
from .operators.build import Index, IndexBuilder
from .plans.query import Clause, Presence, Query, Wildcard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_built: dict[tuple, Index] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # one exchange of the texts, for the join and for the index
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = _read(spark, sf_dir, "documents").repartition(n, "doc_id").join(labels, "doc_id", "left")
    return docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", (F.coalesce("quality", F.lit(0)) + 1.0).alias("boost"))


def _builder() -> IndexBuilder:
    return IndexBuilder(ENGLISH).ref_field("doc_id").doc_boost("boost").field("title", 10).field("text", 1)


def _kept(spark: SparkSession, key: tuple, make: Callable[[], Index]) -> Index:
    """One index a session and folder: what it staged is read by all queries."""
    key = (id(spark), *key)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    return _kept(spark, (sf_dir, "documents"), lambda: _builder().build(_corpus(spark, sf_dir), spread=True))


def parts_index(spark: SparkSession, sf_dir: str) -> Index:
    return _kept(spark, (sf_dir, "part"), lambda: IndexBuilder().ref_field("p_partkey").field("p_name", 3).field("p_type", 1).k1(1.5).b(0.5).build(_read(spark, sf_dir, "part")))


def benchmark_index(spark: SparkSession, sf_dir: str) -> Index:
    return _kept(spark, (sf_dir, "benchmark"), lambda: IndexBuilder().ref_field("item_id").field("text").build(_read(spark, sf_dir, "benchmark")))


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# ---- SQL of the index ----

_SPLIT = r"[ \t\n\r\f\v\x{A0}-]"
_EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS, key=lambda w: (w[::-1])))


def _m(s: str) -> str:
    return f"len(regexp_extract_all({s}, '[aeiouy]+[^aeiouy]+'))"


def _cvc(s: str) -> str:
    return f"regexp_matches({s}, '[^aeiouy][aeiouy][^aeiouywx]$')"


def _cut(s: str, n: int) -> str:
    return f"left({s}, length({s}) - {n})"


def _cases(rules: list[tuple[str, str]], least: int, more: str = "") -> str:
    out = "CASE"
    for end, new in rules:
        rest = _cut("w", len(end))
        out += f" WHEN suffix(w, '{end}') AND length(w) > {len(end)} THEN CASE WHEN {_m(rest)} > {least} THEN {rest} || '{new}' ELSE w END"
    return out + more + " ELSE w END"


def _stem_sql(source: str) -> str:
    """CTEs that end in stems(word, stem), of the words of ``source``."""
    derived = "ational:ate tional:tion biliti:ble ization:ize iveness:ive fulness:ful ousness:ous entli:ent ousli:ous ation:ate alism:al aliti:al iviti:ive logi:log ator:ate alli:al izer:ize anci:ance enci:ence eli:e bli:ble"
    shortened = "icate:ic alize:al iciti:ic ative: ical:ic ness: ful:"
    dropped = "ement ment ible able ence ance ize ive ous iti ate ism ent ant ou ic er al"
    pairs = lambda t: [tuple(p.split(":")) for p in t.split()]
    e = _cut("w", 1)
    ion = f" WHEN regexp_matches(w, '.[st]ion$') AND {_m(_cut('w', 3))} > 1 THEN {_cut('w', 3)}"
    return rf"""
p0 AS (SELECT DISTINCT word, word AS w FROM {source}),
p1 AS (SELECT word, CASE WHEN suffix(w, 'sses') AND length(w) > 4 OR suffix(w, 'ies') AND length(w) > 3 THEN {_cut('w', 2)}
  WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND length(w) > 2 THEN {_cut('w', 1)} ELSE w END AS w FROM p0),
p2 AS (SELECT word, w, CASE WHEN suffix(w, 'eed') AND length(w) > 3 THEN NULL WHEN suffix(w, 'ed') AND length(w) > 2 THEN {_cut('w', 2)}
  WHEN suffix(w, 'ing') AND length(w) > 3 THEN {_cut('w', 3)} END AS c FROM p1),
p3 AS (SELECT word, w, CASE WHEN regexp_matches(c, '[aeiouy]') THEN c END AS c FROM p2),
p4 AS (SELECT word, c IS NOT NULL AS done, CASE
  WHEN c IS NOT NULL THEN CASE WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e'
    WHEN length(c) > 1 AND right(c, 1) = left(right(c, 2), 1) AND regexp_matches(c, '\p{{L}}$') AND NOT regexp_matches(c, '[aeiouylsz]$') THEN {_cut('c', 1)}
    WHEN {_m('c')} = 1 AND {_cvc('c')} THEN c || 'e' ELSE c END
  WHEN suffix(w, 'eed') AND length(w) > 3 THEN CASE WHEN {_m(_cut('w', 3))} > 0 THEN {_cut('w', 3)} || 'e' ELSE w END
  ELSE w END AS w FROM p3),
p5 AS (SELECT word, CASE WHEN NOT done AND regexp_matches(w, '.[^aeiou]y$') THEN {_cut('w', 1)} || 'i' ELSE w END AS w FROM p4),
p6 AS (SELECT word, {_cases(pairs(derived), 0)} AS w FROM p5),
p7 AS (SELECT word, {_cases(pairs(shortened), 0)} AS w FROM p6),
p8 AS (SELECT word, {_cases([(x, '') for x in dropped.split()], 1, ion)} AS w FROM p7),
p9 AS (SELECT word, CASE WHEN suffix(w, 'e') AND length(w) > 1 AND ({_m(e)} > 1 OR {_m(e)} = 1 AND NOT {_cvc(e)}) THEN {e} ELSE w END AS w FROM p8),
stems AS (SELECT word, CASE WHEN strlen(word) < 3 THEN word WHEN suffix(w, 'll') AND {_m('w')} > 1 THEN {_cut('w', 1)} ELSE w END AS stem FROM p9)"""


_DOC_FIELDS = """
doc AS (SELECT d.doc_id::VARCHAR AS doc_ref, 1.0::DOUBLE + coalesce(l.q, 0) AS boost, coalesce(d.text, '') AS text
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
fld AS (SELECT doc_ref, boost, 'title' AS field, 10.0::DOUBLE AS fboost, split_part(text, chr(10), 1) AS txt FROM doc
  UNION ALL SELECT doc_ref, boost, 'text', 1.0::DOUBLE, text FROM doc),"""

_PART_FIELDS = """
fld AS (SELECT p_partkey::VARCHAR AS doc_ref, 1.0::DOUBLE AS boost, 'p_name' AS field, 3.0::DOUBLE AS fboost, coalesce(p_name, '') AS txt FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 1.0::DOUBLE, 'p_type', 1.0::DOUBLE, coalesce(p_type, '') FROM part),"""


def _index_sql(fields: str, k1: str = "1.2", b: str = "0.75") -> str:
    return f"""WITH {fields}
cut AS (SELECT doc_ref, field, regexp_replace(unnest(string_split_regex(lower(txt), '{_SPLIT}')), '{_EDGE}', '', 'g') AS word FROM fld),
kept AS (SELECT doc_ref, field, word FROM cut WHERE word <> '' AND word NOT IN ({_STOPS})),{_stem_sql('kept')},
counted AS (SELECT k.doc_ref, k.field, s.stem AS term, count(*) AS tf FROM kept k JOIN stems s ON k.word = s.word GROUP BY ALL),
lens AS (SELECT f.doc_ref, f.field, any_value(f.boost) AS boost, any_value(f.fboost) AS fboost, coalesce(any_value(t.n), 0)::BIGINT AS length
  FROM fld f LEFT JOIN (SELECT doc_ref, field, sum(tf) AS n FROM counted GROUP BY ALL) t ON f.doc_ref = t.doc_ref AND f.field = t.field GROUP BY ALL),
stats AS (SELECT field, count(*) AS n_docs, sum(length)::DOUBLE / count(*) AS average FROM lens GROUP BY field),
vocab AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
postings AS (SELECT c.term, c.field, c.doc_ref, c.tf,
  round(ln(1 + abs((st.n_docs - v.df + 0.5::DOUBLE) / (v.df + 0.5::DOUBLE))) * (({k1}::DOUBLE + 1) * c.tf)
    / ({k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * (l.length / st.average)) + c.tf) * l.fboost * l.boost * 1000) / 1000 AS weight
  FROM counted c JOIN lens l ON c.doc_ref = l.doc_ref AND c.field = l.field JOIN stats st ON c.field = st.field JOIN vocab v ON c.term = v.term)"""


_DOCS = _index_sql(_DOC_FIELDS)
_PARTS = _index_sql(_PART_FIELDS, "1.5", "0.5")


def _word(w: str) -> str:
    return f"term = (SELECT stem FROM stems WHERE word = '{w}')"


def _search_sql(base: str, clauses: list[tuple], fields: tuple = ("title", "text"), negated: bool = False) -> str:
    """``clauses``: (presence, boost, fields or None, predicate on term, times)."""
    asked = []
    for n, (presence, boost, own, where, times) in enumerate(clauses):
        listed = ", ".join(f"('{f}')" for f in (own or fields))
        asked.append(f"SELECT {n} AS clause_no, '{presence}' AS presence, {boost}::DOUBLE * {times} AS boost, f.field, v.term FROM vocab v, (VALUES {listed}) AS f(field) WHERE {where}")
    required = [n for n, c in enumerate(clauses) if c[0] == "required"]
    sql = f"""{base},
asked AS ({' UNION ALL '.join(asked)}),
norms AS (SELECT field, sqrt(sum(w * w)) AS norm FROM (SELECT field, term, sum(boost) AS w FROM asked GROUP BY ALL) GROUP BY field),
met AS (SELECT p.doc_ref, p.field, a.clause_no, a.presence, a.boost * p.weight AS x FROM postings p JOIN asked a ON p.field = a.field AND p.term = a.term),
by_field AS (SELECT doc_ref, field, sum(x) AS dot, bool_or(presence <> 'prohibited') AS wanted FROM met GROUP BY ALL),
scores AS (SELECT b.doc_ref, sum(dot / norm) AS score FROM by_field b JOIN norms n ON b.field = n.field WHERE wanted AND dot / norm <> 0 GROUP BY b.doc_ref),
flags AS (SELECT doc_ref, bool_or(presence = 'prohibited') AS banned, count(DISTINCT clause_no) FILTER (presence = 'required') AS required FROM met GROUP BY doc_ref)
"""
    if negated:
        return sql + "SELECT doc_ref AS ref, 0.0::DOUBLE AS score FROM lens GROUP BY doc_ref HAVING sum(length) > 0 AND doc_ref NOT IN (SELECT doc_ref FROM flags WHERE banned)"
    return sql + f"SELECT s.doc_ref AS ref, round(s.score, 6) AS score FROM scores s JOIN flags f ON s.doc_ref = f.doc_ref WHERE NOT f.banned AND f.required = {len(required)}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _search(name: str, query, clauses: list[tuple], negated: bool = False, index=documents_index, base: str = _DOCS, fields: tuple = ("title", "text")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = index(spark, sf_dir)
        return _rounded(ix.query(query(ix) if callable(query) else query) if not isinstance(query, str) else ix.search(query))

    _query(name, _search_sql(base, clauses, fields, negated))(run)


# ---- tokens and terms ----


@_query(
    "tokenize_positions",
    rf"""
WITH s AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '{_SPLIT}') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS k FROM s),
p AS (SELECT doc_id, term, k, coalesce(sum(length(term) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS idx, term, start::INTEGER AS start, length(term)::INTEGER AS length FROM p WHERE term <> ''
""",
)
def tokenize_positions(spark, sf_dir):
    from pyspark.sql import Window

    tokens = explode_tokens(_read(spark, sf_dir, "documents"), ENGLISH, "text", ["doc_id"]).where("raw is not null")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return tokens.select("doc_id", at.cast("int").alias("idx"), F.col("raw").alias("term"), "start", "length")


def _words(spark, sf_dir):
    raw = _read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0B\x{A0}-]", -1)).alias("raw"))
    word = ENGLISH.trim(F.col("raw"))
    return raw.select(word.alias("word")).where(F.col("word") != "").distinct()


_WORDS_SQL = f"WITH w AS (SELECT DISTINCT regexp_replace(unnest(string_split_regex(lower(coalesce(text, '')), '{_SPLIT}')), '{_EDGE}', '', 'g') AS word FROM documents)"


@_query("trimmed_words", f"{_WORDS_SQL} SELECT word, word IN ({_STOPS}) AS stop FROM w WHERE word <> ''")
def trimmed_words(spark, sf_dir):
    return _words(spark, sf_dir).withColumn("stop", ENGLISH.is_stop_word(F.col("word")))


@_query("stem_vocabulary", f"{_WORDS_SQL}, x AS (SELECT word FROM w WHERE word <> ''),{_stem_sql('x')} SELECT word, stem FROM stems")
def stem_vocabulary(spark, sf_dir):
    return stem(_words(spark, sf_dir).withColumn("stem", F.col("word")), "stem")


@_query("term_frequencies", f"{_DOCS} SELECT doc_ref, field, term, tf FROM counted")
def term_frequencies(spark, sf_dir):
    return documents_index(spark, sf_dir).counts.select("doc_ref", "field", "term", "tf")


@_query("field_lengths", f"{_DOCS} SELECT doc_ref, field, length FROM lens")
def field_lengths(spark, sf_dir):
    return documents_index(spark, sf_dir).doc_fields.select("doc_ref", "field", F.col("length").cast("long").alias("length"))


@_query("field_averages", f"{_DOCS} SELECT field, n_docs, round(average, 9) AS average FROM stats")
def field_averages(spark, sf_dir):
    return documents_index(spark, sf_dir).field_stats.select("field", "n_docs", F.round("average", 9).alias("average"))


@_query("document_frequencies", f"{_DOCS} SELECT term, df, round(ln(1 + abs(((SELECT any_value(n_docs) FROM stats) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS idf FROM vocab")
def document_frequencies(spark, sf_dir):
    ix = documents_index(spark, sf_dir)
    n = F.broadcast(ix.field_stats.agg(F.max("n_docs").alias("n")))
    return ix.vocab.join(n, F.lit(True)).select("term", "df", F.round(W.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@_query("bm25_weights", f"{_DOCS} SELECT doc_ref, field, term, weight FROM postings")
def bm25_weights(spark, sf_dir):
    return documents_index(spark, sf_dir).postings.select("doc_ref", "field", "term", "weight")


@_query("parts_weights", f"{_PARTS} SELECT doc_ref, field, term, tf, weight FROM postings")
def parts_weights(spark, sf_dir):
    return parts_index(spark, sf_dir).postings.select("doc_ref", "field", "term", "tf", "weight")


# ---- searches ----

_ANY = ("optional", 1, None)
_search("search_term", "license", [(*_ANY, _word("license"), 1)])
_search("search_or", "license rights general", [(*_ANY, _word(w), 1) for w in ("license", "rights", "general")])
_search("search_required", "+license +general rights", [("required", 1, None, _word("license"), 1), ("required", 1, None, _word("general"), 1), (*_ANY, _word("rights"), 1)])
_search("search_prohibited", "license -general", [(*_ANY, _word("license"), 1), ("prohibited", 1, None, _word("general"), 1)])
_search("search_negated", "-license -rights", [("prohibited", 1, None, _word("license"), 1), ("prohibited", 1, None, _word("rights"), 1)], negated=True)
_search("search_field", "title:license text:rights", [("optional", 1, ("title",), _word("license"), 1), ("optional", 1, ("text",), _word("rights"), 1)])
_search("search_boost", "license^5 rights", [("optional", 5, None, _word("license"), 1), (*_ANY, _word("rights"), 1)])
_search("search_prefix", "licen*", [(*_ANY, "term LIKE 'licen%'", 1)])
_search("search_suffix", "*cens", [(*_ANY, "term LIKE '%cens'", 1)])
_search("search_infix_wildcard", "l*s +right*", [(*_ANY, "term LIKE 'l%s'", 1), ("required", 1, None, "term LIKE 'right%'", 1)])
# each place of the middle letters is a way of its own, so a term counts as often as it holds them
_search("search_multi_wildcard", "*cen*", [(*_ANY, "term LIKE '%cen%'", "(len(string_split(v.term, 'cen')) - 1)")])
_search("search_fuzzy", "licens~1 publ~1", [(*_ANY, "levenshtein(term, 'licen') <= 1 AND term NOT SIMILAR TO '.*[^\\x00-\\x7F].*'", 1), (*_ANY, "levenshtein(term, 'publ') <= 1 AND term NOT SIMILAR TO '.*[^\\x00-\\x7F].*'", 1)])
_search("search_mixed", "+licen* -title:rights general~0 text:public^3", [("required", 1, None, "term LIKE 'licen%'", 1), ("prohibited", 1, ("title",), _word("rights"), 1), (*_ANY, _word("general"), 1), ("optional", 3, ("text",), _word("public"), 1)])
_search("search_unknown_required", "license +zzzzunknown", [(*_ANY, "false", 1)])
_search(
    "search_clauses",
    lambda ix: Query(ix.fields).clause(Clause("licen", wildcard=Wildcard.TRAILING, boost=2.0)).clause(Clause("right", fields=("text",), presence=Presence.REQUIRED, use_pipeline=False)),
    [("optional", 2, None, "term LIKE 'licen%'", 1), ("required", 1, ("text",), "term = 'right'", 1)],
)
_search("search_leading_wildcard", lambda ix: Query(ix.fields).clause(Clause("cens", wildcard=Wildcard.LEADING)), [(*_ANY, "term LIKE '%cens'", 1)])
_search("search_both_wildcards", lambda ix: Query(ix.fields).clause(Clause("cens", wildcard=Wildcard.BOTH)), [(*_ANY, "term LIKE '%cens%'", "(len(string_split(v.term, 'cens')) - 1)")])
_search("search_wildcard_beats_edits", "licen*~2", [(*_ANY, "term LIKE 'licen%'", 1)])
_search("search_empty", "", [(*_ANY, "false", 1)])
_search("search_parts", "+p_type:medium ring", [("required", 1, ("p_type",), _word("medium"), 1), (*_ANY, _word("ring"), 1)], index=parts_index, base=_PARTS, fields=("p_name", "p_type"))


_MANY = {"a": "license", "b": "rights", "c": "license rights", "d": "-license"}


def _many_sql() -> str:
    ask = f"""SELECT 'a' AS q, 'optional' AS presence, v.term FROM vocab v WHERE {_word('license')}
  UNION ALL SELECT 'b', 'optional', v.term FROM vocab v WHERE {_word('rights')}
  UNION ALL SELECT 'c', 'optional', v.term FROM vocab v WHERE {_word('license')} OR {_word('rights')}
  UNION ALL SELECT 'd', 'prohibited', v.term FROM vocab v WHERE {_word('license')}"""
    return f"""{_DOCS},
ask AS ({ask}),
met AS (SELECT a.q, p.doc_ref, p.field, a.presence, p.weight FROM ask a JOIN postings p ON a.term = p.term),
norms AS (SELECT q, sqrt(count(*)) AS norm FROM ask GROUP BY q),
f AS (SELECT m.q, doc_ref, field, sum(weight) / any_value(norm) AS s FROM met m JOIN norms n ON m.q = n.q WHERE presence = 'optional' GROUP BY ALL),
r AS (SELECT q, doc_ref, sum(s) AS score FROM f WHERE s <> 0 GROUP BY ALL
  UNION ALL SELECT 'd', doc_ref, 0.0 FROM lens GROUP BY doc_ref HAVING sum(length) > 0 AND doc_ref NOT IN (SELECT doc_ref FROM met WHERE q = 'd')),
t AS (SELECT q, doc_ref, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_ref) AS rank FROM r)
SELECT q AS query_id, rank::INTEGER AS rank, doc_ref AS ref, score FROM t WHERE rank <= 10"""


@_query("search_many_topk", _many_sql())
def search_many_topk(spark, sf_dir):
    return _rounded(documents_index(spark, sf_dir).search_many(_MANY, 10))


_POSITIONS_SQL = rf"""{_DOCS},
s AS (SELECT doc_ref, field, string_split_regex(lower(txt), '{_SPLIT}') AS ws FROM fld),
u AS (SELECT doc_ref, field, unnest(ws) AS raw, unnest(range(1, len(ws) + 1)) AS k FROM s),
p AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_ref, field ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT p.doc_ref AS ref, st.stem AS term, p.field, p.start::INTEGER AS start, length(p.raw)::INTEGER AS length
FROM p JOIN stems st ON regexp_replace(p.raw, '{_EDGE}', '', 'g') = st.word"""


@_query(
    "match_positions",
    rf"""{_POSITIONS_SQL}
WHERE st.stem IN (SELECT stem FROM stems WHERE word IN ('license', 'rights'))
  AND EXISTS (SELECT 1 FROM postings q WHERE q.doc_ref = p.doc_ref AND q.field = p.field AND q.weight <> 0
    AND q.term IN (SELECT stem FROM stems WHERE word IN ('license', 'rights')))""",
)
def match_positions(spark, sf_dir):
    return _positions(documents_index(spark, sf_dir).search("license rights", matches=True))


def _positions(found: DataFrame) -> DataFrame:
    terms = found.select("ref", F.explode("terms").alias("term", "fields"))
    fields = terms.select("ref", "term", F.explode("fields").alias("field", "positions"))
    return fields.select("ref", "term", "field", F.inline("positions"))


@_query(
    "match_positions_twice",
    f"{_POSITIONS_SQL} CROSS JOIN (VALUES (1), (2)) AS twice(k) WHERE st.stem = (SELECT stem FROM stems WHERE word = 'license')",
)
def match_positions_twice(spark, sf_dir):
    """A term that two clauses hit lists its positions twice."""
    return _positions(documents_index(spark, sf_dir).search("license license", matches=True))


# ---- scripts ----

_SAMPLES = (("a1", "中文文档，用于测试搜索 rust-lang Engine!"), ("a2", "日本語のドキュメント検索 test"), ("a3", "한국어 문서 검색 한中 end"), ("a4", "plain words only"))


def _with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of all documents, which have no such scripts, and of a few texts that do."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return docs.unionByName(spark.createDataFrame(_SAMPLES, "id string, text string"))


_SAMPLES_SQL = f"""d(id, text) AS (SELECT doc_id::VARCHAR, coalesce(text, '') FROM documents
  UNION ALL VALUES {", ".join(f"('{k}', '{t}')" for k, t in _SAMPLES)}),
ch AS (SELECT id, unnest(range(1, length(t) + 1)) AS k, unnest(string_split(t, '')) AS a FROM (SELECT id, lower(text) AS t FROM d) WHERE t <> '')"""


def _script_sql(name: str, script: str) -> str:
    """CTEs that end in {name}(id, start, length, term), of the characters in ``ch``."""
    return rf"""
x_{name} AS (SELECT id, k, a, regexp_matches(a, '[{script}]') AS s, regexp_matches(a, '{_SPLIT}') AS sep FROM ch),
n_{name} AS (SELECT *, lead(s) OVER (PARTITION BY id ORDER BY k) AS s2, lead(a) OVER (PARTITION BY id ORDER BY k) AS a2,
  k - row_number() OVER (PARTITION BY id, NOT s AND NOT sep ORDER BY k) AS run FROM x_{name}),
{name} AS (SELECT id, (k - 1)::INTEGER AS start, 1 AS length, a AS term FROM n_{name} WHERE s
  UNION ALL SELECT id, (k - 1)::INTEGER, 2, a || a2 FROM n_{name} WHERE s AND s2
  UNION ALL SELECT id, (min(k) - 1)::INTEGER, count(*)::INTEGER, string_agg(a, '' ORDER BY k) FROM n_{name} WHERE NOT s AND NOT sep GROUP BY id, run)"""


def _script_tokens(name: str, language, script: str) -> None:
    oracle = f"WITH {_SAMPLES_SQL},{_script_sql('own', script)} SELECT id, start, length, term FROM own"

    def run(spark, sf_dir):
        tokens = explode_tokens(_with_samples(spark, sf_dir), language, "text", ["id"])
        return tokens.where("raw is not null").select("id", "start", "length", F.col("raw").alias("term"))

    _query(name, oracle)(run)


_RE2 = {
    "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}",
    "kana": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
}
_script_tokens("tokens_zh", CHINESE, _RE2["han"])
_script_tokens("tokens_ja", JAPANESE, _RE2["han"] + _RE2["kana"])
_script_tokens("tokens_ko", KOREAN, _RE2["hangul"] + _RE2["han"])


_ASKED_SCRIPTS = {"zh": ("中文", ("中", "文", "中文")), "ja": ("検索", ("検", "索", "検索")), "ko": ("한국어", ("한국어", "한", "국", "어", "한국", "국어")), "en": ("engine", ("engin",))}


def _scripts_sql() -> str:
    """Several languages at once: each raw term once a text, trimmed unless it begins with a script, then stems."""
    cjk = "".join(_RE2.values())
    raws = f"""{_SAMPLES_SQL},{_script_sql('zh', _RE2['han'])},{_script_sql('ja', _RE2['han'] + _RE2['kana'])},{_script_sql('ko', _RE2['hangul'] + _RE2['han'])},
raws AS (SELECT id, term FROM zh UNION SELECT id, term FROM ja UNION SELECT id, term FROM ko
  UNION SELECT id, unnest(string_split_regex(lower(text), '{_SPLIT}')) FROM d),
fld AS (SELECT id AS doc_ref, 1.0::DOUBLE AS boost, 'text' AS field, 1.0::DOUBLE AS fboost, '' AS txt FROM d),"""
    index = _index_sql(raws)
    start, end = index.index("cut AS ("), index.index("kept AS (")
    trim = f"CASE WHEN regexp_matches(term, '^[{cjk}]') THEN term ELSE regexp_replace(term, '{_EDGE}', '', 'g') END"
    index = index[:start] + f"cut AS (SELECT id AS doc_ref, 'text' AS field, {trim} AS word FROM raws),\n" + index[end:]
    asked = ", ".join(f"('{q}', '{t}')" for q, (_, terms) in _ASKED_SCRIPTS.items() for t in terms)
    return f"""{index},
asked AS (SELECT q, term FROM (VALUES {asked}) AS a(q, term) JOIN vocab USING (term)),
norms AS (SELECT q, sqrt(count(*)) AS norm FROM asked GROUP BY q),
scores AS (SELECT a.q, p.doc_ref, sum(p.weight) / any_value(n.norm) AS score FROM asked a JOIN postings p ON a.term = p.term JOIN norms n ON a.q = n.q GROUP BY ALL)
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_ref)::INTEGER AS rank, doc_ref AS ref, round(score, 6) AS score FROM scores WHERE score <> 0"""


@_query("search_scripts", _scripts_sql())
def search_scripts(spark, sf_dir):
    ix = _kept(spark, (sf_dir, "scripts"), lambda: IndexBuilder(multi(CHINESE, JAPANESE, KOREAN, ENGLISH)).field("text").build(_with_samples(spark, sf_dir), positions=False))
    return _rounded(ix.search_many({k: q for k, (q, _) in _ASKED_SCRIPTS.items()}))


# ---- vectors ----


@_query(
    "vector_functions",
    """
SELECT vec_id, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 6) AS dot,
  round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 6) AS magnitude,
  round(coalesce(embedding[1], 0)::DOUBLE, 6) AS similarity, (2 * len(embedding))::INTEGER AS flat
FROM embeddings WHERE embedding IS NOT NULL""",
)
def vector_functions(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").where("embedding is not null")
    v = W.vector(F.sequence(F.lit(0), F.size("embedding") - 1), F.transform("embedding", lambda x: x.cast("double")))
    unit = W.vector(F.array(F.lit(0)), F.array(F.lit(1.0)))
    back = W.from_flat(W.to_flat(v))
    return e.select("vec_id", F.round(W.dot(v, v), 6).alias("dot"), F.round(W.magnitude(v), 6).alias("magnitude"), F.round(W.similarity(unit, v), 6).alias("similarity"), F.size(W.to_flat(W.upsert(back, F.lit(0), F.lit(0.0)))).alias("flat"))


# ---- sources and sinks ----


_BENCHMARK = _index_sql("""
fld AS (SELECT item_id::VARCHAR AS doc_ref, 1.0::DOUBLE AS boost, 'text' AS field, 1.0::DOUBLE AS fboost, coalesce(text, '') AS txt FROM benchmark),""")


@_query(
    "json_round_trip",
    f"""{_BENCHMARK},
asked AS (SELECT term FROM vocab WHERE term LIKE 't%'),
scores AS (SELECT 'a' AS q, doc_ref, sum(weight) / (SELECT sqrt(count(*)) FROM asked) AS score FROM postings WHERE term IN (SELECT term FROM asked) GROUP BY doc_ref
  UNION ALL SELECT 'b', doc_ref, 0 FROM lens WHERE length > 0)
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_ref)::INTEGER AS rank, doc_ref AS ref, round(score, 6) AS score FROM scores WHERE q = 'b' OR score <> 0""",
)
def json_round_trip(spark, sf_dir):
    from .sources.index_io import from_json, to_json

    ix = benchmark_index(spark, sf_dir)
    return _rounded(from_json(spark, to_json(ix)).search_many({"a": "t*", "b": "-zzz"}))


_PRESET = _index_sql("""
doc AS (SELECT doc_id::VARCHAR AS doc_ref, coalesce(text, '') AS text FROM documents),
fld AS (SELECT doc_ref, 1.0::DOUBLE AS boost, 'title' AS field, 1.0::DOUBLE AS fboost, split_part(text, chr(10), 1) AS txt FROM doc
  UNION ALL SELECT doc_ref, 1.0::DOUBLE, 'text', 1.0::DOUBLE, text FROM doc),""")


@_query("json_documents", _search_sql(_PRESET, [(*_ANY, _word("license"), 1), ("prohibited", 1, None, _word("general"), 1)]))
def json_documents(spark, sf_dir):
    """Documents written and read as JSON, the preset index of them, and results as JSON texts, parsed again."""
    import uuid

    from .sources.index_io import build_documents, read_documents, results_json
    from .sources.staging import staging_folder

    path = f"{staging_folder(spark)}/documents-{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents")
    docs.select(F.col("doc_id").cast("string").alias("location"), F.substring_index("text", "\n", 1).alias("title"), "text").write.json(path)
    ix = _kept(spark, (sf_dir, "preset"), lambda: build_documents(read_documents(spark, path, lines=True)))
    out = results_json(ix.search("license -general"))
    return _rounded(out.select(F.from_json("result", "ref string, score double").alias("r")).select("r.ref", "r.score"))


@_query("parquet_round_trip", _search_sql(_PARTS, [(*_ANY, _word("medium"), 1)], ("p_name", "p_type")))
def parquet_round_trip(spark, sf_dir):
    import uuid

    from .sources.index_io import load, save
    from .sources.staging import staging_folder

    path = f"{staging_folder(spark)}/index-{uuid.uuid4().hex}"
    save(parts_index(spark, sf_dir), path)
    return _rounded(load(spark, path).search("medium"))


@_query("stream_append", _search_sql(_PARTS, [(*_ANY, _word("medium"), 1)], ("p_name", "p_type")))
def stream_append(spark, sf_dir):
    import uuid

    from .sources.staging import staging_folder
    from .streaming.append import append_stream, open_index

    at = f"{staging_folder(spark)}/stream-{uuid.uuid4().hex}"
    part = _read(spark, sf_dir, "part")
    part.repartition(3).write.parquet(f"{at}/in")
    builder = IndexBuilder().ref_field("p_partkey").field("p_name", 3).field("p_type", 1).k1(1.5).b(0.5)
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    append_stream(stream, builder, f"{at}/raw", f"{at}/progress").awaitTermination()
    return _rounded(open_index(spark, builder, f"{at}/raw").search("medium"))
