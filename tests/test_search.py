import json
import math
import random
import re

import pytest

from lexispark import CHINESE, ENGLISH, JAPANESE, KOREAN, IndexBuilder, multi
from lexispark.functions.languages import Language
from lexispark.operators import build as build_module
from lexispark.operators import search as search_module
from lexispark.sources.index_io import build_documents, from_json, load, read_documents, results_json, save, to_json

PAGES = [
    ("a", "Quick start", "Install the engine, then start it quickly.", None),
    ("b", "Search syntax", "Wildcards like foo* and fuzzy searches; foobar too.", None),
    ("c", "中文", "只有中文。", None),
    ("d", "Engines", "", 2.0),
    ("e", None, "!!! ...", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    docs = spark.createDataFrame(PAGES, "id string, title string, text string, boost double")
    return IndexBuilder().doc_boost("boost").field("title", 10).field("text").build(docs).cache()


def refs(df):
    return [r["ref"] for r in df.collect()]


def test_terms_presence_and_order(pages):
    assert refs(pages.search("engine")) == ["d", "a"]
    assert refs(pages.search("+engine -install")) == ["d"]
    assert refs(pages.search("-engine")) == ["b", "c"]  # e has no terms
    assert refs(pages.search("title:engine")) == ["d"]
    assert refs(pages.search("")) == [] and refs(pages.search("the")) == []
    assert refs(pages.search("+the engine")) == [] and refs(pages.search("+!!! engine")) == []
    assert len(refs(pages.search("engine foo*", limit=1))) == 1


def test_wildcards_and_edits(pages):
    assert refs(pages.search("foo*")) == ["b"] and refs(pages.search("*bar")) == ["b"] and refs(pages.search("f*r")) == ["b"]
    assert refs(pages.search("fobar~1")) == ["b"] and refs(pages.search("fobar")) == []
    one, many = (pages.search(q).first()["score"] for q in ("foo*", "*o*"))
    assert one > 0 and many > 0


def test_matches(pages):
    row = pages.search("start start", matches=True).collect()[0]
    assert row["ref"] == "a"
    spots = {f: [(p["start"], p["length"]) for p in ps] for f, ps in row["terms"]["start"].items()}
    assert spots == {"title": [(6, 5), (6, 5)], "text": [(25, 5), (25, 5)]}


def test_many(pages):
    rows = pages.search_many({"x": "engine", "y": "-engine", "z": "zzz"}, 1).collect()
    assert sorted((r["query_id"], r["rank"], r["ref"]) for r in rows) == [("x", 1, "d"), ("y", 1, "b")]


def test_scripts(spark):
    docs = spark.createDataFrame([("1", "中文文档 搜索"), ("2", "日本語"), ("3", "한국어"), ("4", "rust")], "id string, text string")
    for lang, q, want in ((CHINESE, "中文", "1"), (JAPANESE, "日本語", "2"), (KOREAN, "한국어", "3"), (multi(CHINESE, ENGLISH), "rust", "4")):
        assert want in refs(IndexBuilder(lang).field("text").build(docs).search(q))


def test_configuration(spark):
    with pytest.raises(ValueError):
        IndexBuilder().field("a").field("a")
    with pytest.raises(ValueError):
        IndexBuilder().field("a/b")
    assert IndexBuilder().b(7).b_ == 1.0 and IndexBuilder().field("a", -1).fields == {"a": 0.0}
    empty = IndexBuilder().field("text").build(spark.createDataFrame([], "id string, text string"))
    assert refs(empty.search("a -b")) == []


def test_round_trips(spark, pages, tmp_path):
    text = to_json(pages)
    j = json.loads(text)
    assert list(j) == ["version", "language", "fields", "fieldVectors", "invertedIndex", "pipeline"]
    again = from_json(spark, text)
    save(pages, f"file://{tmp_path}/ix")
    stored = load(spark, f"file://{tmp_path}/ix")
    for q in ("engine", "+start -foo*", "-engine", "s*"):
        want = [(r["ref"], r["score"]) for r in pages.search(q).collect()]
        for other in (again, stored):
            got = [(r["ref"], r["score"]) for r in other.search(q).collect()]
            assert [g[0] for g in got] == [w[0] for w in want]
            assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    with pytest.warns(UserWarning):
        from_json(spark, text, "zh")


def test_documents_preset(spark, tmp_path):
    at = tmp_path / "docs.json"
    at.write_text(json.dumps([{"location": "x", "title": "One", "text": "two"}, {"location": "y", "text": "one", "boost": 3}]))
    ix = build_documents(read_documents(spark, str(at)))
    assert refs(ix.search("one")) == ["y", "x"]
    assert json.loads(results_json(ix.search("one")).first()["result"])["ref"] == "y"
    with pytest.raises(ValueError, match="document missing location"):
        build_documents(spark.createDataFrame([(None, "a", "b", 1.0)], "location string, title string, text string, boost double"))


def brute(docs, fields, query, k1=1.2, b=0.75):
    """Scores of optional whole words, straight from the definition; words are their own stems."""
    tf, length = {}, {}
    for d, (boost, texts) in docs.items():
        for f in fields:
            ws = re.findall(r"[a-z]+", texts[f])
            length[d, f] = len(ws)
            for w in ws:
                tf[d, f, w] = tf.get((d, f, w), 0) + 1
    n = len(docs)
    df = {}
    for _, _, w in tf:
        df[w] = df.get(w, 0) + 1
    avg = {f: sum(length[d, f] for d in docs) / n for f in fields}
    out = {}
    for f, fb in fields.items():
        known = [w for w in query if w in df]
        q = {w: known.count(w) for w in known}
        norm = math.sqrt(sum(x * x for x in q.values()))
        for d, (boost, _) in docs.items():
            s = 0
            for w, x in q.items():
                t = tf.get((d, f, w))
                if t:
                    idf = math.log(1 + abs((n - df[w] + 0.5) / (df[w] + 0.5)))
                    s += x * math.floor(idf * ((k1 + 1) * t) / (k1 * (1 - b + b * length[d, f] / avg[f]) + t) * fb * boost * 1000 + 0.5) / 1000
            if s:
                out[d] = out.get(d, 0) + s / norm
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["bak", "dok", "fip", "gom", "hut", "jaz"]
    docs = {f"d{k}": (rng.choice([1.0, 2.0, 0.5]), {f: " ".join(rng.choices(words, k=rng.randrange(0, 9))) for f in ("p", "q")}) for k in range(25)}
    df = spark.createDataFrame([(d, bo, t["p"], t["q"]) for d, (bo, t) in docs.items()], "id string, boost double, p string, q string")
    ix = IndexBuilder().doc_boost("boost").field("p", 4).field("q", 1).build(df, positions=False).cache()
    for _ in range(3):
        query = rng.choices(words + ["zzz"], k=rng.randrange(1, 4))
        got = {r["ref"]: r["score"] for r in ix.search(" ".join(query)).collect()}
        assert got == pytest.approx(brute(docs, {"p": 4, "q": 1}, query), abs=2e-3)


TEXTS = [(f"d{k:02d}", t) for k, t in enumerate(["running water", "run wild", "wool and water", "wild wolves wander", "iron wheel", "wheels of iron run", "", None])]


def test_few_words_become_filters(spark, tmp_path):
    ix = IndexBuilder().field("body").build(spark.createDataFrame(TEXTS, "id string, body string"))
    save(ix, f"file://{tmp_path}/ix")
    stored = load(spark, f"file://{tmp_path}/ix")
    for q, terms in (("water", ["water"]), ("wo*", ["wolv", "wool"]), ("rum~1", ["run"]), ("*ate* -iron", ["iron", "water"])):
        plan = stored.search(q)._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.split("\n") if "FileScan" in x and "weight" in x)
        filters = scan[scan.index("PushedFilters") :]
        assert all(t in filters for t in terms) and ("In(term" in filters or "EqualTo(term" in filters), q
        assert "NestedLoop" not in plan


def test_many_words_are_joined(spark, monkeypatch):
    ix = IndexBuilder().field("body").build(spark.createDataFrame(TEXTS, "id string, body string")).cache()
    queries = {"a": "water", "b": "w*", "c": "rum~1 +w*", "d": "-wil*", "e": "+zzz water", "f": "w*l* run^3", "g": "*"}
    few = [tuple(r) for r in ix.search_many(queries).orderBy("query_id", "rank").collect()]
    found = ix.search("w*l* run", matches=True).collect()
    for name in ("EXPANDED", "ASKED"):
        monkeypatch.setattr(search_module, name, 0)
        many = [tuple(r) for r in ix.search_many(queries).orderBy("query_id", "rank").collect()]
        assert [r[:3] for r in many] == [r[:3] for r in few] and [r[3] for r in many] == pytest.approx([r[3] for r in few])
        assert [(r["ref"], r["terms"]) for r in ix.search("w*l* run", matches=True).collect()] == [(r["ref"], r["terms"]) for r in found]


def test_words_belong_to_their_language(spark):
    docs = spark.createDataFrame(TEXTS, "id string, body string")
    plain = Language("en", stems=False, stop_words=frozenset())
    assert IndexBuilder().field("body").build(docs).search("running").count() == 3
    assert [r["ref"] for r in IndexBuilder(plain).field("body").build(docs).search("running").collect()] == ["d00"]


def test_rare_words_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([*TEXTS, ("d90", "runs, running; RUNNING, the wheels wheel")], "id string, body string")
    want = sorted(map(tuple, IndexBuilder().field("body").build(docs).postings.collect()))
    for limit in (0, 150, 400):
        monkeypatch.setattr(build_module, "VOCABULARY_BYTES", limit)
        assert sorted(map(tuple, IndexBuilder().field("body").build(docs).postings.collect())) == want


def test_json_without_weights_is_an_error(spark):
    ix = IndexBuilder().field("body").build(spark.createDataFrame(TEXTS, "id string, body string"))
    j = json.loads(to_json(ix))
    j["fieldVectors"] = [["/".join(reversed(k.split("/"))), v] for k, v in j["fieldVectors"]]
    with pytest.raises(ValueError):
        from_json(spark, json.dumps(j))
