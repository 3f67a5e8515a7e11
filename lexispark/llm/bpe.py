"""Byte-level BPE, encoding and decoding, through a minimal transducer lexicon.

Counts of all words of the corpus choose the most frequent ``LEXICON_WORDS``;
their ids are compiled into an acyclic transducer with shared suffixes
(``lexicon``), shipped to every executor once and memory-mapped.  A text is
cut at boundaries that the splitting pattern never lets a token cross; each
piece is looked up in the worker's table, then in the transducer, and a word
in neither is merged exactly by the library's own model.  The lexicon thus
changes the speed only, never an id.

Decoding gathers every id's bytes from one flat table, a slice of texts at a
time.

Nulls are empty texts: no ids, and an empty decoded text.  Repeated rows are
encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import drop_table, new_path, table, write_bytes
from .kernels import slices
from .lexicon import Lexicon, build

#: Words that are compiled at most: bounds the lexicon's file to a few MB.
LEXICON_WORDS = 50_000
#: Distinct words a counting task holds before it passes them on.
COUNTED_AT_ONCE = 400_000

#: Runs where a cut at single spaces and line ends could differ from the pattern's.
_RUNS = re.compile(r"\s{3}|\s\s\Z")
#: An optional space and letters, then marks: two pre-tokens whatever they are.
_WORD_BYTES = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)\Z")


def pieces(raw: bytes) -> list[bytes]:
    """Cuts before every space and around every line end."""
    return raw.replace(b" ", b"\xff ").replace(b"\n", b"\xff\n\xff").split(b"\xff")


class Codec:
    """A byte-level tokenizer file with its lexicon; one per worker."""

    def __init__(self, path: str, lexicon: str | None = None):
        self.tokenizer = words.load(path)
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pre = j["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or j["normalizer"]:
            raise ValueError("a byte-level tokenizer with the standard pattern is needed")
        self.special = [t["content"] for t in j["added_tokens"]]
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.table: dict[bytes, bytes] = {b"": b""}
        self.stems: dict[bytes, bytes] = {b"": b""}
        chars = {c: b for b, c in enumerate(words.BYTE_CHARS)}
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        raw = [b""] * size
        for token, i in j["model"]["vocab"].items():
            raw[i] = bytes(chars[c] for c in token)
        for t in j["added_tokens"]:
            raw[t["id"]] = t["content"].encode("utf-8")
        self.bytes_of = _Flat(raw)
        self.digits_of = _Flat([b"%d," % i for i in range(size)])

    def _merge(self, piece: bytes) -> bytes:
        return np.array(self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        return np.array(words.pre_token_ids(self.tokenizer, word.decode("utf-8")), dtype="<u4").tobytes()

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that the table doesn't hold."""
        split = [_WORD_BYTES.match(p) for p in new]
        todo = list({m[1] for m in split if m and m[1] not in self.stems})
        found: dict[bytes, bytes] = {}
        if self.lexicon is not None and todo:
            for w, r in zip(todo, self.lexicon.ranks(todo).tolist()):
                if r >= 0:
                    found[w] = self.lexicon.ids_of(r).tobytes()
        for w in todo:
            if w not in found:
                found[w] = self._word(w)
        if len(self.stems) < words.WORDS_KEPT:
            self.stems |= found
        out = {}
        for p, m in zip(new, split):
            if m is None:
                out[p] = self._merge(p)
            else:
                head, tail = m[1], m[2]
                ids = found.get(head) or self.stems[head]
                if tail:
                    end = self.stems.get(tail)
                    if end is None:
                        end = self.stems[tail] = self._merge(tail)
                    ids += end
                out[p] = ids
        return out

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each."""
        cut, whole = [], {}
        for k, raw in enumerate(raws):
            text = raw.decode("utf-8")
            if _RUNS.search(text) or any(s in text for s in self.special):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                cut.append([])
            else:
                cut.append(pieces(raw))
        table = self.table
        new = [p for p in set().union(*cut) if p not in table]
        if new:
            got = self.learn(new)
            if len(table) < words.WORDS_KEPT:
                table |= got
            else:
                table = _Both(table, got)
        get = table.__getitem__
        parts = [whole[k] if k in whole else b"".join(map(get, c)) for k, c in enumerate(cut)]
        off = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
        return np.frombuffer(b"".join(parts), dtype="<u4"), off

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that aren't UTF-8 become U+FFFD, as in the library."""
        raw, at = self.bytes_of.gather(ids, off)
        return [raw[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(at[:-1], at[1:])]

    def digits(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Decimal ids of each text, joined by commas."""
        raw, at = self.digits_of.gather(ids, off)
        return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]


class _Both(dict):
    """A full table and a slice's own words."""

    def __init__(self, table: dict, own: dict):
        super().__init__(own)
        self.rest = table

    def __missing__(self, key):
        return self.rest[key]


class _Flat:
    """Byte strings by index, for vectorised concatenation."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(values), dtype=np.uint8)

    def gather(self, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, list[int]]:
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.at[ids] - ends[:-1], n)
        where += np.arange(len(where))
        return self.blob[where].tobytes(), ends[off].tolist()


def _codec(path: str, lexicon: str | None) -> Codec:
    got = words._loaded.get(("codec", path, lexicon))
    if got is None:
        for k in [k for k in words._loaded if k[0] == "codec"]:  # one lexicon's tables at a time
            del words._loaded[k]
        got = words._loaded["codec", path, lexicon] = Codec(path, SparkFiles.get(lexicon) if lexicon else None)
    return got


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often every word that a lexicon could hold occurs, over all texts.

    Tasks pass on partial counts, of at most ``COUNTED_AT_ONCE`` words at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            got: Counter = Counter()
            for p, n in held.items():
                m = _WORD_BYTES.match(p)
                if m:
                    got[m[1]] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, buf, off in slices(batch):
                raw = buf.tobytes()
                # a row's end is a cut as well
                held.update(pieces(raw) if len(off) == 2 else [p for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for p in pieces(raw[a:b])])
                if len(held) > COUNTED_AT_ONCE:
                    yield flush()
        yield flush()

    partial = df.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def make_lexicon(df: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the corpus's most frequent words; returns the shipped file's name.

    The driver holds ``size`` words, whatever the corpus.
    """
    spark = df.sparkSession
    counted = table(word_counts(df, text), "words")
    # the least count that at most ``size`` words reach: a histogram decides, no sort
    bins = counted.groupBy(F.floor(16 * F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    least, held = None, 0
    for r in sorted(bins, key=lambda r: -r["b"]):
        held += r["words"]
        if held > size:
            break
        least = r["n"]
    top = counted.where(F.col("n") >= least).collect() if least is not None else []
    drop_table(counted)
    tok = words.load(path)
    found = {bytes(r["word"]): words.pre_token_ids(tok, bytes(r["word"]).decode("utf-8")) for r in top}
    at = new_path(spark, "lexicon") + ".bin"
    write_bytes(spark, at, build(found))
    spark.sparkContext.addFile(at)
    return os.path.basename(at)


def _raws(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    raw, off = buf.tobytes(), off.tolist()
    return [raw[a:b] for a, b in zip(off[:-1], off[1:])]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", lexicon: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, lexicon)
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                ids, at = codec.encode(_raws(buf, off))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every list of ids; a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, None)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            off = np.concatenate([[0], np.cumsum(sizes)])
            texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8") for t in texts], pa.string())], names=[key, "text"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(key, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", lexicon: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids.

    Map-side only: no text or id is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, lexicon)
        sha = hashlib.sha256
        for batch in batches:
            for part, buf, off in slices(batch, "text", 1 << 20):
                ids, at = codec.encode(_raws(buf, off))
                digests = [sha(x).hexdigest() for x in codec.digits(ids, at)]
                back = [sha(x).hexdigest() for x in codec.decode(ids, at)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(key, F.col(text).alias("text")).mapInArrow(run, schema)
