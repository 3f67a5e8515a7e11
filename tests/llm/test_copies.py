import hashlib
import random
import re

import numpy as np
import pytest

from test_rows import morse

from lexispark.llm.components import components
from lexispark.llm.kernels import word_spans
from lexispark.llm.ngram_join import _candidates, _product, ngram_join
from lexispark.llm.suffix_array import permuted_lcp, suffix_array
from lexispark.llm import suffix_dedup as sd
from lexispark.llm.suffix_dedup import remove_repeats, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def near_copies(rows, n=5):
    """What the join must return, pair by pair."""
    sets = []
    for r in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r[1] or "").encode()))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = [[j for j, b in enumerate(sets) if j != i and a and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((r[0], len(sets[i]), len(links[i]), min(keys) if keys else None))
    return sorted(out, key=repr)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join(df).collect()), key=repr)


def test_join(rows, docs, nothing):
    assert joined(docs) == near_copies(rows)
    assert joined(nothing) == []


def test_join_without_keys(keyless):
    assert joined(keyless) == near_copies([tuple(r) for r in keyless.collect()])


def test_join_of_a_family(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((k, " ".join(w[: rng.randrange(90, 121)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert joined(df) == near_copies(rows)


def test_overlaps_beyond_two_bytes(spark):
    """A block's cell of two sets of 750,000 n-grams, whose prefixes are the same, and a small pair."""
    m = 750_000
    rng = np.random.default_rng(3)
    prefix = np.sort(rng.choice(2**62, m - m * 80 // 100 + 1, replace=False).astype(np.uint64))
    few = np.arange(3, dtype=np.uint64)
    h = np.concatenate([prefix, prefix, few, few])
    row = np.repeat(np.arange(4, dtype=np.uint16), [len(prefix), len(prefix), 3, 3])
    cls, size = np.array([5, 9, 20, 30], dtype=np.int64), np.array([m, m, 11, 11], dtype=np.int32)
    blocks = spark.createDataFrame([(0, *(bytearray(x.tobytes()) for x in (h, row, cls, size)))], "block int, h binary, row binary, cls binary, size binary")
    for n_parts in (1, 4):
        pairs = _candidates(_product(blocks, 80, 100, 1, n_parts), 80, 100, n_parts)
        assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(5, 9), (20, 30)]


def test_join_of_regular_texts(spark):
    """Thue-Morse words and texts, and their complements, which polynomial hashes take for one."""
    rows = []
    for k, n in enumerate((8, 10, 11)):
        a, b = morse(n)
        rows += [(10 * k, " ".join([a] * 3)), (10 * k + 1, " ".join([b] * 3)), (10 * k + 2, a), (10 * k + 3, b)]
        rows += [(10 * k + 4, " ".join(a)), (10 * k + 5, " ".join(f"{x}{j % 7}" for j, x in enumerate(a))), (10 * k + 6, " ".join(f"{x}{j % 7}" for j, x in enumerate(b)))]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == near_copies(rows)


def test_join_of_very_long_texts(spark):
    """Two texts of 900,000 words that differ in one: blocks' cells exceed two bytes."""
    words = [f"w{k * 7919 % 1_000_003}" for k in range(900_000)]
    other = list(words)
    other[450_000] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "a few words")], "doc_id long, text string").repartition(2)
    assert joined(df) == [(1, 899_996, 1, 1), (2, 899_996, 1, 1), (3, 1, 0, 3)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert got.keys() == near.keys()


def test_word_spans():
    texts = [b"", b"a b", b" c", b"d ", b"", b"\t\n", b"ef  g"]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    s, e, first = word_spans(buf, off)
    assert [bytes(buf[a:b]) for a, b in zip(s, e)] == [b"a", b"b", b"c", b"d", b"ef", b"g"]
    assert np.diff(first).tolist() == [0, 2, 1, 1, 0, 0, 2]


@pytest.mark.parametrize("n, letters", [(1, 1), (2, 1), (40, 2), (500, 1), (700, 4), (900, 255)])
def test_suffix_array(n, letters):
    rng = np.random.default_rng(n)
    for repeat in (1, 4):
        t = np.append(np.tile(rng.integers(1, letters + 1, n), repeat), 0).astype(np.uint8)
        raw = t.tobytes()
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
        phi, lcp = permuted_lcp(t, sa)
        for k in range(1, len(sa)):
            i, j, c = sa[k], sa[k - 1], 0
            while raw[i + c] == raw[j + c]:
                c += 1
            assert (phi[i], lcp[i]) == (j, c)


def cut(raws, length=200):
    count = {}
    for r in raws:
        for k in range(len(r) - length + 1):
            count[r[k : k + length]] = count.get(r[k : k + length], 0) + 1
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for k in range(len(r) - length + 1):
            if count[r[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0])
        kept = np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()
        yield len(r), int(gone.sum()), runs, kept


def held_against_cut(df, rows):
    got = sorted((tuple(r) for r in suffix_dedup(df).collect()), key=repr)
    want = [(r[0], n, g, s, hashlib.sha256(k).hexdigest()) for r, (n, g, s, k) in zip(rows, cut([(r[1] or "").encode() for r in rows]))]
    assert got == sorted(want, key=repr)


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (40, 50, 60, 90, 300)]
    rows = []
    for k in range(40):
        parts = [text(rng.randrange(0, 60)) for _ in range(3)] + rng.choices(shared, k=rng.randrange(0, 3))
        rng.shuffle(parts)
        rows.append((k, " ".join(parts)))
    rows += [(50, "z" * 700), (51, "ab" * 300), (52, "y" * 199), (53, "y" * 200), (54, "y" * 201), (55, rows[0][1]), (56, rows[0][1]), (57, None), (58, ""), (59, shared[4][:250]), (60, shared[4][100:])]
    rows += [(70 + k, f"{text(3)} {shared[2]} {text(3)}") for k in range(8)]
    return rows


def test_repeats(spark, passages):
    held_against_cut(spark.createDataFrame(passages, "doc_id long, text string").repartition(4), passages)


def test_repeats_of_hot_places(spark, passages, monkeypatch):
    """A place's stretches in several shards; and its occurrences in several blocks."""
    monkeypatch.setattr(sd, "HOT", 2)
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(2)
    held_against_cut(df, passages)
    monkeypatch.setattr(sd, "PLACE_LIMIT", 3)
    held_against_cut(df, passages)


def test_repeats_of_regular_texts(spark):
    """Thue-Morse strings and their complements, which polynomial hashes take for one."""
    rows = []
    for k, n in enumerate((9, 10, 11)):
        rows += [(10 * k + j, x[:m]) for j, (x, m) in enumerate([(morse(n)[0], 2**n), (morse(n)[1], 2**n - 3), (morse(n, "cd")[0], 300), (morse(n, "ef")[1], 255)])]
    held_against_cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_repeats_of_odd_rows(rows, docs, nothing, keyless):
    some = [r for r in rows if len(r[1] or "") < 10_000]
    held_against_cut(docs.where("length(coalesce(text, '')) < 10000"), some)
    assert suffix_dedup(nothing).collect() == []
    held_against_cut(keyless, [tuple(r) for r in keyless.collect()])


def test_removal(spark, passages):
    df = spark.createDataFrame([(k, t, len(t or ""), 1) for k, t in passages], "doc_id long, text string, n_chars long, cls int").repartition(3)
    out = remove_repeats(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None)
    want = []
    for (k, t), (_, gone, _, kept) in zip(passages, cut([(t or "").encode() for _, t in passages])):
        if t is not None:
            new = kept.decode("utf-8", "ignore") if gone else t
            want.append((k, new, len(new)))
    assert got == sorted(want)
