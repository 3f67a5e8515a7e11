import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from lexispark.llm import bpe, lexicon, token_files, words  # noqa: E402
from lexispark.llm.token_count import JsonEncoder, PieceEncoder, count_long, token_counts  # noqa: E402
from lexispark.llm.token_files import read_documents, read_ids, read_token_digests, token_index, write_token_files  # noqa: E402

WORD, BYTE, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library_ids(path, text):
    return words.load(path).encode(text or "", add_special_tokens=False).ids


def test_files_hold_all_ids_in_order(spark, rows, docs):
    files = write_token_files(docs, WORD)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_token_digests(files).collect()]
    want, start = [], 0
    packed = sorted((r[0], np.array(library_ids(WORD, r[1]) + [2], dtype="<u4").tobytes()) for r in rows)
    for k, raw in packed:
        want.append((k, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert sorted(got) == want
    assert token_index(spark, files).count() == len(rows)
    first = files.first()["file"]
    assert {c for b in read_ids(first, ["key", "n_tokens"], [0]) for c in b.schema.names} == {"key", "n_tokens"}


def test_files_of_nothing_and_without_keys(nothing, keyless):
    assert read_token_digests(write_token_files(nothing, WORD)).collect() == []
    got = read_token_digests(write_token_files(keyless, WORD)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [5, None, None, None]


def test_files_by_key(spark, rows, docs):
    files = write_token_files(docs, WORD)
    some = sorted({r[0] for r in rows})[10:13]
    got = sorted((r["key"], list(r["ids"])) for r in read_documents(spark, files, some).collect())
    assert got == sorted((r[0], library_ids(WORD, r[1]) + [2]) for r in rows if r[0] in some)


def test_files_of_shared_keys_and_other_keys(spark, monkeypatch):
    """A third of the rows has one key and a third none: they don't meet in one file."""
    rows = [(k if k % 3 == 0 else 7 if k % 3 == 1 else None, f"text {k} " + "more " * (k % 9)) for k in range(300)]
    want = sorted(zlib.crc32(np.array(library_ids(WORD, t) + [2], dtype="<u4").tobytes()) for _, t in rows)
    monkeypatch.setattr(token_files, "FILE_TEXT", 800)
    for kind in ("long", "string"):
        df = spark.createDataFrame([(k if kind == "long" or k is None else f"k{k:04d}", t, 1, 2, 3) for k, t in rows], f"doc_id {kind}, text string, part int, key int, ids int").repartition(3)
        files = write_token_files(df, WORD)
        out = read_token_digests(files, key_type=df.schema["doc_id"].dataType).orderBy("start").collect()
        assert sorted(r["ids_crc32"] for r in out) == want
        keys = [r["doc_id"] for r in out]
        some = [k for k in keys if k is not None]
        assert some == sorted(some) and keys == some + [None] * 100
        sizes = [r["n_tokens"] for r in out]
        assert [r["start"] for r in out] == [sum(sizes[:k]) for k in range(len(sizes))]
        assert max(r["n_rows"] for r in files.collect()) < 60


def test_lower_case_is_found_in_any_place(tmp_path):
    j = json.loads(open(WORD).read())
    j["added_tokens"] = [{"id": 60000 + k, "content": f"<extra_{k}_{'x' * 80}>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k in range(60)] + j["added_tokens"]
    (tmp_path / "t.json").write_text(json.dumps(j))
    assert words.word_table(str(tmp_path / "t.json"), "count").lower is str.lower


def test_counts(rows, docs, nothing, keyless):
    for chunk, overlap in ((16384, 256), (300, 16)):
        got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, WORD, limit=500, chunk_chars=chunk, overlap_chars=overlap).collect())
        want = sorted((r[0], len((r[1] or "").encode()), n, n > 500) for r in rows for n in [len(library_ids(WORD, r[1]))])
        assert got == want
    chunks = {r["n_chunks"]: r["n_bytes"] for r in token_counts(docs, WORD).collect()}
    assert min(chunks) == 1 and chunks[max(chunks)] == max(len((r[1] or "").encode()) for r in rows) > 16384
    assert token_counts(nothing, WORD).collect() == []
    assert token_counts(keyless, WORD).count() == 4


@pytest.mark.parametrize("make, path", [(JsonEncoder, WORD), (PieceEncoder, PIECE), (JsonEncoder, BYTE)])
def test_splices_are_exact(make, path):
    rng = random.Random(7)
    enc = make(path)
    for _ in range(12):
        text = "".join(rng.choices(["tion ", "the ", "é", "ab", "x,", "\n", "  ", "日", " <|endoftext|> ", "'s "], k=600))
        for chunk, overlap in ((400, 40), (90, 4)):
            n, encoded = count_long(enc, text, chunk, overlap)
            assert n == len(enc.encode(text)[0]) and (encoded > 1 or not enc.stable)
    for text in ("a" * 5000, " " * 3000, "ab " * 2000):
        assert count_long(enc, text, 500, 20)[0] == len(enc.encode(text)[0])


def test_round_trip(rows, docs, nothing, keyless):
    made = bpe.make_lexicon(docs, BYTE, size=50)
    for lex in (made, None):
        got = sorted(tuple(r) for r in bpe.round_trip(docs, BYTE, lexicon=lex).collect())
        want = []
        for r in rows:
            ids = library_ids(BYTE, r[1])
            back = words.load(BYTE).decode(ids, skip_special_tokens=False)
            want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.round_trip(nothing, BYTE, lexicon=bpe.make_lexicon(nothing, BYTE)).collect() == []
    assert bpe.round_trip(keyless, BYTE).count() == 4


def test_encode_and_decode_columns(rows, docs):
    ids = bpe.encode(docs.where("doc_id = 0"), BYTE)
    assert ids.first()["ids"] == library_ids(BYTE, rows[0][1])
    assert bpe.decode(ids, BYTE).first()["text"] == rows[0][1]


def test_pieces_against_the_library():
    rng = random.Random(3)
    codec = bpe.Codec(BYTE)
    texts = ["".join(rng.choices(["a", "Bé", " ", " ", "\n", "\t", "'ll", "1", "!?", " ", "<|endoftext|>", "\x1c"], k=rng.randrange(0, 30))) for _ in range(500)]
    ids, off = codec.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == library_ids(BYTE, t), repr(t)


def test_lexicon(tmp_path):
    rng = random.Random(5)
    some = {"".join(rng.choices("abcé", k=rng.randrange(1, 9))).encode(): [rng.randrange(9) for _ in range(rng.randrange(4))] for _ in range(400)}
    raw = lexicon.build(some)
    (tmp_path / "x").write_bytes(raw)
    lx = lexicon.Lexicon(str(tmp_path / "x"))
    asked = [*some, b"", b"zz", b"a" * 99]
    ranks = lx.ranks(asked).tolist()
    assert ranks[-3:] == [-1, -1, -1] and sorted(ranks[:-3]) == list(range(len(some)))
    assert all(lx.ids_of(r).tolist() == some[w] for w, r in zip(asked, ranks) if r >= 0)
    # suffixes are shared: fewer edges than a trie of the words has
    assert len(lx.key) < len({w[:k] for w in some for k in range(1, len(w) + 1)})
    (tmp_path / "y").write_bytes(lexicon.build({}))
    assert lexicon.Lexicon(str(tmp_path / "y")).ranks([b"a"]).tolist() == [-1]


def test_word_counts(rows, docs):
    got = {bytes(r["word"]): r["n"] for r in bpe.word_counts(docs).collect()}
    want = Counter(m[1] for r in rows for p in bpe.pieces((r[1] or "").encode()) for m in [bpe._WORD_BYTES.match(p)] if m)
    assert got == dict(want)
