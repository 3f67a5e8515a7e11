import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F

from test_copies import cut, near_copies  # noqa: E402
from test_rows import brute_mix  # noqa: E402

from lexispark.llm import quality, words  # noqa: E402
from lexispark.llm.mixing import key_hash  # noqa: E402


def make(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(90)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=range(90, 0, -1), k=n))
    shared = text(60)
    rows = [(k, text(rng.randrange(110, 250))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(8)]
    rows += [(200 + k, f"{text(70)} {shared} {text(60)}") for k in range(6)]
    rows += [(300 + k, text(80).upper().replace(" ", "!! ")) for k in range(3)] + [(400, None), (401, "few words"), (402, "again " * 80)]
    return [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = make()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = {r["doc_id"] for r in quality.quality_rules(df).collect() if r["kept"]}
    assert not kept & {300, 301, 302, 400, 401, 402} and set(range(60)) <= kept
    rows = [r for r in rows if r[0] in kept]
    component = {r[0]: r[3] for r in near_copies(rows)}
    rows = [r for r in rows if component[r[0]] == r[0]]
    assert not {r[0] for r in rows} & set(range(100, 108))
    rows = [(r[0], k.decode("utf-8", "ignore") if gone else r[1], *r[2:]) for r, (_, gone, _, k) in zip(rows, cut([r[1].encode() for r in rows]))]
    size, total, target = brute_mix(rows)
    h = {r["doc_id"]: r["h"] for r in spark.createDataFrame(rows, schema).select("doc_id", key_hash("doc_id").alias("h")).collect()}
    tok = words.load(P.path("byte_bpe_50k.json"))
    want = Counter()
    for s in total:
        own = sorted((h[r[0]], n, r) for r, n in zip(rows, size) if r[3] == s)
        passes = int(target[s] // total[s]) if total[s] else 0
        budget, upto = target[s] - passes * total[s], 0
        for _, n, r in own:
            extra = upto + n <= budget or (upto <= budget and 2 * (budget - upto) >= n)
            upto += n
            ids = tok.encode(r[1], add_special_tokens=False).ids
            key = (r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())
            want[key] += min(2, passes + (extra and passes < 2))
    assert got == +want


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcde")
    rows = [(None, a), (None, a + " more"), (5, b), (5, b), (7, c), (7, d), (6, c + " more"), (None, b + " more"), (None, None), (9, e), (None, ""), (None, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.near_copies_stage(spark, df, "")
    got = Counter(map(tuple, out.collect()))
    # of the rows without a key either may stay
    assert got.pop((None, a), 0) + got.pop((None, a + " more"), 0) == 1
    assert got == Counter([(5, b), (7, d), (6, c + " more"), (None, None), (9, e), (None, "")])
    left = corpus_pipeline.repeats_stage(spark, out.withColumn("n_chars", F.length("text")), "").collect()
    assert sum(len(r["text"] or "") > 200 for r in left) == 5


def test_stages_keep_the_columns(spark, docs, nothing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, nothing, "").collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, "").collect() == []
