import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import chat, quality, sharding, vector_search
from lexispark.llm.mixing import mix, mixed_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text)
    windows = {}
    for k in range(len(w) - 7):
        windows.setdefault(tuple(w[k : k + 8]), []).append(k)
    cover = {x for ks in windows.values() if len(ks) > 1 for k in ks for x in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_base(rows, docs, nothing, keyless):
    got = sorted((tuple(r)[:7] for r in quality.quality_rules(docs).collect()), key=repr)
    assert got == sorted(((r[0], *base(r[1] or "")) for r in rows), key=repr)
    assert quality.quality_rules(nothing).collect() == []
    assert quality.quality_rules(keyless).count() == 4


def morse(n, letters="ab"):
    """The Thue-Morse string of 2 ** n letters and its complement, which polynomials take for one."""
    x = [bin(k).count("1") % 2 for k in range(2**n)]
    return "".join(letters[b] for b in x), "".join(letters[1 - b] for b in x)


def test_quality_of_regular_texts(spark):
    rows = []
    for k, n in enumerate((8, 10, 11, 12)):
        a, b = morse(n)
        rows += [(10 * k, f"{a}\n{b}\n{a}"), (10 * k + 1, f"{a}\n{b}"), (10 * k + 2, " ".join([a, b] * 12)), (10 * k + 3, " ".join(a) + " " + " ".join(b))]
    got = sorted(tuple(r)[:7] for r in quality.quality_rules(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")).collect())
    assert got == sorted((k, *base(t)) for k, t in rows)


def test_quality_divergence(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(60)]
    rows = []
    for k in range(400):
        t = " ".join(rng.choices(words, weights=range(60, 0, -1), k=300))
        if k % 40 == 0:
            t = t.upper().replace(" ", "!! ")
        rows.append((k, t, "en" if k % 2 else "xx"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    refs = quality.references(df)
    # the references cover all documents
    counts, classes = Counter(), np.zeros(quality.N_CLASSES)
    for _, t, lang in rows:
        if lang == "en":
            counts.update(WORD.findall(t.lower()))
            classes += np.bincount(quality.CLASSES[np.frombuffer(t.encode(), dtype=np.uint8)], minlength=quality.N_CLASSES + 1)[: quality.N_CLASSES]
    total = sum(counts.values())
    assert refs["en"][0] == pytest.approx(classes / classes.sum())
    assert sorted(refs["en"][2]) == pytest.approx(sorted(n / total for n in counts.values() if n >= quality.COMMON_SHARE * total))
    got = {r["doc_id"]: r for r in quality.quality_rules(df, refs=refs).collect()}
    assert {k for k, r in got.items() if not r["kept"]} == set(range(0, 400, 40))
    assert {r["doc_id"] for r in quality.quality_filter(df, refs=refs).collect()} == {k for k, r in got.items() if r["kept"]}
    # distances against the definition
    k, t, _ = rows[1]
    w = Counter(WORD.findall(t.lower()))
    common = {x: n / total for x, n in counts.items() if n >= quality.COMMON_SHARE * total}
    p = [w[x] / 300 for x in common] + [1 - sum(w[x] for x in common) / 300]
    q = [*common.values(), 1 - sum(common.values())]
    js = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a > 1e-12) / 2 + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b > 1e-12) / 2
    assert got[1]["word_distance"] == pytest.approx(math.sqrt(js), abs=1e-6)


def prose(rng, letters, n_docs, n):
    """Documents of an invented language with words of its own."""
    words = ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(60)]
    return [" ".join(rng.choices(words, weights=range(60, 0, -1), k=n)) for _ in range(n_docs)]


def test_quality_of_small_and_unknown_languages(spark, monkeypatch):
    rng = random.Random(12)
    big, small, rare = prose(rng, "abcdefgh", 100, 300), prose(rng, "mnopqrst", 20, 100), prose(rng, "ijkluvwx", 8, 60)
    junk = [" ".join("".join(rng.choices("abcdefghmnopqrst", k=5)) for _ in range(300)), "!! ".join(small[0].upper().split())]
    texts = [(t, "big") for t in big] + [(t, "small") for t in small] + [(t, "rare") for t in rare]
    texts += [(t, lang) for t in (big[0], small[0]) for lang in (None, "")] + [(t, None) for t in junk]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    refs = quality.references(df)
    assert {"big", "small", "rare"} <= refs.keys()
    got = {r["doc_id"]: r for r in quality.quality_rules(df, refs=refs).collect()}
    bad = {len(texts) - 2, len(texts) - 1}
    assert {k for k, r in got.items() if not r["kept"]} == bad
    # without a language: the distances to the one that fits
    for k, own in ((128, 0), (129, 0), (130, 100), (131, 100)):
        assert (got[k]["class_distance"], got[k]["word_distance"]) == pytest.approx((got[own]["class_distance"], got[own]["word_distance"]))
    # beyond the largest languages, and where there are none: byte classes only
    monkeypatch.setattr(quality, "LANGUAGES", 1)
    some = quality.quality_rules(df.where("lang = 'big' or lang = 'small' or lang = 'rare'")).collect()
    assert all(r["kept"] for r in some) and all(r["word_distance"] == 0 for r in some if r["doc_id"] >= 100)
    none = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df.withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert not none.pop(len(texts) - 1) and all(none.values())


def test_quality_of_short_texts(spark):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(60)]
    draw = lambda n: " ".join(rng.choices(words, weights=range(60, 0, -1), k=n))
    texts = [draw(400) for _ in range(60)] + [draw(n) for n in range(20, 75) for _ in range(4)]
    clean = len(texts)
    texts += ["".join(w + rng.choice(["%%% ", "&&& ", "### "]) for w in draw(n).split()) for n in (20, 27, 50, 74)]
    texts += [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n)) for n in (60, 74)]  # words of no language
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    assert {r["doc_id"] for r in quality.quality_rules(df).collect() if not r["kept"]} == set(range(clean, len(texts)))


def test_shards(rows, docs, nothing, keyless, monkeypatch):
    out = sharding.shard(docs).collect()
    total = sum(r["size"] for r in out)
    largest = max(r["size"] for r in out)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / 8 + largest
    assert sharding.shard(nothing).collect() == []
    assert sorted(r["slot"] for r in sharding.shard(keyless, 1).collect()) == [0, 1, 2, 3]
    monkeypatch.setattr(sharding, "RANGE_ROWS", 4)  # several ranges a shard
    by = {}
    for r in sharding.shard(docs, 3, keep=("lang",)).collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sum(map(len, by.values())) == len(rows)


def test_shards_split_a_hot_text(spark):
    rows = [(k, "same text " * 5 if k % 3 == 0 else f"text {k} " * 5) for k in range(600)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert len(size) == 8 and max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 8 + 120
    again = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def brute_mix(rows):
    """Targets and taken words from the definition; hashes as documented."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in zip(rows, size) if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    capped = set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (1.5 * sum(size) - 2 * sum(total[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            break
        capped |= over
    return size, total, {s: 2.0 * total[s] if s in capped else weight[s] * level for s in sources}


def test_mix(rows, docs, nothing, keyless):
    size, total, target = brute_mix(rows)
    out = mix(docs).collect()
    key = {(r[0], n, total[r[3]]) for r, n in zip(rows, size)}
    assert {(r["doc_id"], r["size"], r["source_size"]) for r in out} == key
    taken, largest = Counter(), Counter()
    by_size = {v: s for s, v in total.items()}
    for r in out:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix(docs.repartition(5)).collect()))
    assert mix(nothing).collect() == [] and mix(keyless).count() == 4
    words = Counter()
    for r in mixed_rows(docs).collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert words == +taken
    assert mixed_rows(docs).columns == docs.columns


def test_search(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        v = rng.normal(size=8) * rng.choice([0.1, 1.0, 30.0])
        rows.append((k, [float(x) for x in v]))
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (405, []), (406, rows[100][1]), (407, rows[100][1]), (500, [0.0] * 8), (600, [1.0, -2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vectors = vector_search.quantised(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect())
    usable = {k: [math.floor(1024 * x) for x in v] for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in usable:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), k) for k, v in usable.items() if k != q and len(v) == len(usable[q]))[:10]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)]
    assert got == sorted(want)


def test_search_of_huge_numbers_and_nothing(spark):
    rows = [(k, [1e6 + k, -3e5 * k]) for k in range(0, 40)]
    vectors = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vector_search.top_k(vectors, vectors.where("vec_id = 0"), 3).collect()
    q = {k: [math.floor(1024 * x) for x in v] for k, v in rows}
    want = sorted((-(q[0][0] * v[0] + q[0][1] * v[1]), k) for k, v in q.items() if k)[:3]
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(n + 1, k) for n, (_, k) in enumerate(want)]
    # whatever is finite takes part, also where 1024-fold components and lengths overflow
    rng = random.Random(2)
    big = [5e15, -5e15, 2.0**61, 1e200, -1e200, 1e306, -1.7e308, 3.0, -0.5, 0.0, 7e6]
    rows = [(k, [rng.choice(big), rng.choice(big)]) for k in range(60)]
    vectors = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    whole = {k: [int(x) * 1024 if abs(x) > 2**60 else math.floor(1024 * x) for x in v] for k, v in rows}
    want = []
    for a in range(0, 60, 7):
        pinned = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(whole[a], whole[b])))), b) for b in whole if b != a)[:9]
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(pinned)]
    assert sorted(map(tuple, vector_search.top_k(vectors, vectors.where("vec_id % 7 = 0"), 9).collect())) == sorted(want)
    rows = [(k, [1e15, 1.0]) for k in range(5)]
    vectors = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    pinned = vector_search.top_k(vectors, vectors.where("vec_id = 3"), 2).collect()
    assert sorted((r["vec_id"], r["score"]) for r in pinned) == [(0, 2**63 - 1), (1, 2**63 - 1)]
    none = vector_search.quantised(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert vector_search.top_k(none, none).collect() == []


def test_search_prunes(spark):
    """Unit vectors: lengths bound nothing, coordinates do; long ones: lengths do."""
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(3000, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    stretched = unit * rng.lognormal(0, 2, 3000)[:, None]
    for v, way in ((unit, "by_coordinates"), (stretched, "skipped")):
        df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
        vectors = vector_search.quantised(df)
        asked = vectors.where("vec_id % 100 = 0")
        report = vector_search.pruning_report(vectors, asked).agg(*[F.sum(c).alias(c) for c in ("cells", "skipped", "by_length", "by_coordinates", "multiplied", "verified")]).first()
        assert report["cells"] == 3000 * 30 == report["skipped"] + report["by_length"] + report["by_coordinates"]
        assert report[way] > report["cells"] / 2 and report["multiplied"] + report["verified"] < report["cells"] / 3
        got = sorted(map(tuple, vector_search.top_k(vectors, asked).collect()))
        q = np.floor(1024 * v)
        want = []
        for k in range(0, 3000, 100):
            s = q @ q[k]
            best = sorted((-int(x), i) for i, x in enumerate(s) if i != k)[:10]
            want += [(k, n + 1, i, -x) for n, (x, i) in enumerate(best)]
        assert got == sorted(want)


def test_escapes():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choices(["<", "|", "\\", ">", "im_end", "\n", "a", "<|im_end|>\n"], k=rng.randrange(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.parse_piece(f"{chat.START}{chat._escape_role(t)}\n{chat.escape(t)}{chat.END}") == (t, t)


def test_conversations(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(9), None]), rng.choice(["user", "assistant", None, "a\nb"]), rng.choice(["hi", "<|im_end|>", None, "", "é\n<\\|x"])) for _ in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(chat.format_turns(chat.canonical_rows(df))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, r, t in own if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for _, r, t in own)
        chars = sum(len(f"{chat.START}{chat._escape_role(r)}\n{chat.escape(t)}{chat.END}") for _, r, t in own)
        assert got[c] == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert chat.digests(chat.format_turns(df.limit(0))).collect() == []


def test_names_of_other_layouts_as_extra_columns(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = [tuple(r) for r in chat.digests(chat.format_turns(df)).collect()]
    names = {p.split(".")[-1] for m in chat.MAPPINGS for p in m.paths} - {"[]", *df.columns}
    for c in [*names, "_id", "_x", "seq", "piece"]:
        assert [tuple(r) for r in chat.digests(chat.format_turns(chat.canonical_rows(df.withColumn(c, F.lit("z"))))).collect()] == want, c
    for c in names:
        df = df.withColumn(c, F.lit("z"))
    assert sorted(map(tuple, chat.canonical_rows(df).collect())) == rows
    value = {"prompt": "q", "response": "a", "value": 1, "answer": 2, "role": "x", "turn": 3}
    got = chat.canonical_json(spark.createDataFrame([(1, json.dumps(value))], "id long, body string"), "body", "id").first()
    assert got["layout"] == "prompt" and [t["text"] for t in got["turns"]] == ["q", "a"]


def test_layouts(spark):
    user, bot = {"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}
    values = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "noise": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
        {"turns": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]},
    ]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(90, '{"other": 1}'), (91, "{broken"), (92, None), (93, "[1]")]
    out = {r["conv_id"]: r for r in chat.canonical_json(spark.createDataFrame(rows, "id long, body string"), "body", "id").collect()}
    for k in range(len(values)):
        assert [t.asDict() for t in out[k]["turns"]] == [user, bot]
    assert all(out[k]["turns"] is None for k in (90, 91, 92, 93))
    got = chat.canonical_json(spark.createDataFrame([(1, json.dumps({"instruction": "i", "input": "", "output": "o"}))], "id long, body string"), "body", "id").first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("system", "i"), ("assistant", "o")]
    struct = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r["role"], r["text"]) for r in chat.canonical_rows(struct).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_rows(spark.createDataFrame([(1,)], "x int"))
