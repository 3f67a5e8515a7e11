"""The queries themselves, over a folder of small tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from test_copies import cut, near_copies
from test_rows import base, brute_mix

from lexispark.llm import common, words
from lexispark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows, docs):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.where("length(coalesce(text, '')) < 10000").write.parquet(f"{at}/documents.parquet")
    rng = random.Random(1)
    talks = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "", "<|im_end|>"])) for c in range(5) for t in range(4)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("answer", F.lit(1)).write.parquet(f"{at}/conversations.parquet")
    vectors = [(k, [rng.gauss(0, 1) for _ in range(6)], 0) for k in range(250)] + [(300, None, 0), (400, [None] * 6, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, [r for r in rows if len(r[1] or "") < 10_000], talks, vectors


def run(spark, folder, name):
    return QUERIES[name](spark, folder[0]).collect()


def ids(name, text):
    return words.load(P.path(name)).encode(text or "", add_special_tokens=False).ids


def test_op1(spark, folder):
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, folder, "op1_token_files")}
    assert got == {(r[0], len(x) + 1, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*x, 2]))) for r in folder[1] for x in [ids("word_bpe_49k.json", r[1])]}


def test_op2(spark, folder):
    said = "<|im_end|><|im_start|>assistant ok"
    talks = folder[2] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in run(spark, folder, "op2_chat_format")}
    for c in {t[0] for t in talks}:
        own = [(r or "", t or "") for k, _, r, t in talks if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got.pop(c) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got


def test_op3(spark, folder):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run(spark, folder, "op3_token_counts"))
    assert got == sorted((r[0], len((r[1] or "").encode()), n, n > 2048) for r in folder[1] for n in [len(ids("word_bpe_49k.json", r[1]))])


def test_op4(spark, folder):
    assert sorted(map(tuple, run(spark, folder, "op4_ngram_join")), key=repr) == near_copies(folder[1])


def test_op5(spark, folder):
    tok = words.load(P.path("byte_bpe_50k.json"))
    want = []
    for r in folder[1]:
        x = ids("byte_bpe_50k.json", r[1])
        want.append((r[0], len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, run(spark, folder, "op5_bpe_round_trip"))) == sorted(want)


def test_op6(spark, folder):
    got = run(spark, folder, "op6_quality_rules")
    assert sorted(tuple(r)[:7] for r in got) == sorted((r[0], *base(r[1] or "")) for r in folder[1])
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op7(spark, folder):
    got = run(spark, folder, "op7_histogram_shards")
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((r[0], len(t) + 1, zlib.crc32(t)) for r in folder[1] for t in [(r[1] or "").encode()])
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert slots.keys() <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8(spark, folder):
    usable = {k: [math.floor(1024 * x) for x in v] for k, v, _ in folder[3] if v and None not in v}
    want = []
    for a in (0, 100, 200):
        best = sorted((-sum(x * y for x, y in zip(usable[a], v)), b) for b, v in usable.items() if b != a)[:10]
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in run(spark, folder, "op8_vector_search")) == want


def test_op9(spark, folder):
    want = [(r[0], n, g, s, hashlib.sha256(k).hexdigest()) for r, (n, g, s, k) in zip(folder[1], cut([(r[1] or "").encode() for r in folder[1]]))]
    assert sorted(map(tuple, run(spark, folder, "op9_suffix_dedup"))) == sorted(want)


def test_op10(spark, folder):
    size, total, target = brute_mix(folder[1])
    got = run(spark, folder, "op10_mix")
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((r[0], n, total[r[3]], round(target[r[3]], 6)) for r, n in zip(folder[1], size))
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = {}

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)
