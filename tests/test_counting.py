"""Counting in Arrow batches against the languages' own column expressions."""

import random
from dataclasses import dataclass

import pyarrow as pa
import pytest

from lexispark import CHINESE, ENGLISH, JAPANESE, KOREAN, IndexBuilder, multi
from lexispark.functions.languages import Language, MultiLanguage
from lexispark.functions.stemming import stem
from lexispark.functions.words import Words, alphabet, plain
from lexispark.operators import counting as counting_module
from lexispark.operators.build import _Build


@dataclass(frozen=True)
class Own(Language):
    """A language of one's own, which may redefine anything."""


@dataclass(frozen=True)
class OwnMulti(MultiLanguage):
    """The same of several."""


def own(language):
    return (OwnMulti if isinstance(language, MultiLanguage) else Own)(**vars(language))


ODD = [*"aeiouy", *"bdlst", "ing", "ed", "eed", "ation", "sses", "The", "Running", "é", "ß", "İ", "Σ", "ς", "́", "ǅ", "ⅷ", "²", "٣", "​", "ͅ", "\x85", " ", "_", "'", "...", "中", "文字", "한국", "かな", "ｶ", "😀", "𝒳", "𠀀", "\x00", *" \t\n\r\f\v\xa0- -- "]


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    return [(f"d{k}", "".join(rng.choices(ODD, k=rng.randrange(0, 60))), rng.choice([None, 0.5, 2.0])) for k in range(n)] + [("none", None, None), ("empty", "", 1.0), (None, "no ref", 1.0)]


@pytest.mark.parametrize("language", [ENGLISH, CHINESE, multi(CHINESE, JAPANESE, KOREAN, ENGLISH)], ids=lambda x: x.code)
@pytest.mark.parametrize("positions", [True, False])
def test_as_the_expressions_have_it(spark, language, positions):
    docs = spark.createDataFrame(odd_texts(1), "id string, text string, boost double")
    assert plain(language) and not plain(own(language))
    a, b = (IndexBuilder(x).doc_boost("boost").field("text", 2).field("id").build(docs, positions) for x in (language, own(language)))
    for table in ("postings", "vocab", "doc_fields"):
        got, want = (sorted(map(repr, getattr(x, table).collect())) for x in (a, b))
        assert got == want and got, table


def test_stems_of_many_words(spark):
    rng = random.Random(2)
    ends = "s es ies sses ss ed eed ing y ational tional biliti ization iveness fulness ousness entli ousli ation alism aliti iviti logi ator alli izer anci enci eli bli icate alize iciti ative ical ness ful ement ment ible able ence ance ize ive ous iti ate ism ent ant ou ic er al ion sion tion e l ll".split()
    heads = ["".join(rng.choices("aeioubdfglnrstwxyzé", k=rng.randrange(0, 6))) for _ in range(3000)]
    words = sorted({h + "".join(rng.choices(ends, k=rng.randrange(0, 3))) for h in heads} - {""})
    want = {r["word"]: r["stem"] for r in stem(spark.createDataFrame([(w, w) for w in words], "word string, stem string"), "stem").collect()}
    found = Words(Language("en", stems=True), *alphabet(spark))
    assert all(found.terms[found[w]] == want[w] for w in words)


def test_no_word_is_looked_up_in_a_table(spark):
    """However many words there are, counting is one exchange of whole texts."""
    docs = spark.createDataFrame(odd_texts(3), "id string, text string, boost double")
    plan = _Build(IndexBuilder().field("text"), docs, True).counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_chunks_hold_whole_documents(spark, monkeypatch, chunk):
    monkeypatch.setattr(counting_module, "CHUNK", chunk)
    rows = [(r, f, 1.0, t) for r, t in (("a", "x y x"), ("b", "y"), ("b", "y z"), ("c", ""), (None, "x")) for f in ("p", "q")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 3]), (pa.string(), pa.string(), pa.float64(), pa.string()))], names=["doc_ref", "field", "doc_boost", "text"]) for k in range(0, len(rows), 3)]
    out = pa.Table.from_batches(counting_module.counting(ENGLISH, alphabet(spark), True)(iter(batches))).to_pylist()
    found = {(r["doc_ref"], r["field"], r["term"]): (r["tf"], r["length"]) for r in out}
    assert len(found) == len(out)
    want = {("a", "x"): (2, 3), ("a", "y"): (1, 3), ("b", "y"): (2, 3), ("b", "z"): (1, 3), (None, "x"): (1, 1)}
    assert {k: v for k, v in found.items() if k[2]} == {(r, f, t): v for (r, t), v in want.items() for f in ("p", "q")}
    assert {k[0]: v[1] for k, v in found.items() if not k[2]} == {"a": 3, "b": 3, "c": 0, None: 1}
    assert [p["start"] for r in out if r["doc_ref"] == "a" and r["field"] == "p" and r["term"] == "x" for p in r["positions"]] == [0, 4]


def test_terms_are_skipped_by(spark):
    """A staged chunk is in order of terms, and its files say so by page."""
    docs = spark.createDataFrame([(str(k), f"w{k:04d} common") for k in range(2000)], "id string, text string")
    ix = IndexBuilder().field("text").build(docs)
    assert ix.search("w0007").count() == 1
    plan = ix.search("w0007")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and all("EqualTo(term" in x or "In(term" in x for x in scans)
