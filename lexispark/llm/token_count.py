"""Token counts of whole texts, long ones by overlap resynchronisation.

A text above ``chunk_chars`` is encoded in overlapping chunks with offsets.
Two neighbouring chunks are spliced at a boundary inside their overlap that
is *proven* stable: the tokenizer's own settings show that what follows it is
encoded without regard to what precedes, both chunks have a token starting
there, and their tokens agree from there to the last such boundary of the
overlap.  Where an overlap has no such boundary it is doubled and the chunk
encoded again, in the end with all of the rest of the text, so the count is
always that of the whole text.  A worker holds one chunk's tokens at a time.

Texts up to a chunk are counted whole: where the tokenizer's settings prove
that words are encoded independently, as the sum of their words' counts from
the worker's bounded table (the library counts what isn't in it), else by the
library at once.

Nulls count as empty texts (0 tokens).  Repeated rows are counted each; an
empty table gives an empty result.  Only the key and the text are read; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words
from .kernels import buffers

#: Characters of a chunk and of an overlap, both documented parameters.
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256

_SPACES = frozenset(" \t\n\r\x0b\x0c")


class JsonEncoder:
    """The ``tokenizers`` library; boundaries after ASCII white space if its settings prove them."""

    shift = 0

    def __init__(self, path: str):
        self.tokenizer = words.load(path)
        self.stable = words.splits_at_space(path)
        self.table = words.word_table(path, "count") if self.stable else None

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(e.ids, dtype=np.int64), np.array([a for a, _ in e.offsets], dtype=np.int64)

    def short(self, texts: list[bytes]) -> list[int]:
        if self.table is not None:
            get = self.table.__getitem__
            return [sum(map(get, t.split())) for t in texts]
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def is_stable(self, text: str, p: int) -> bool:
        return self.stable and text[p - 1] in _SPACES and text[p] not in _SPACES


class PieceEncoder:
    """The ``sentencepiece`` library; a lone space before a word is a boundary
    if no piece of the vocabulary continues from a character over a space."""

    shift = 1  # in the left chunk the token begins at the space itself

    def __init__(self, path: str):
        self.model = words.load(path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = self.model.encode("a  b"), self.model.encode("a b")
        self.stable = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a") == self.model.encode("b a")[-1:] and probe[0] != probe[1]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        proto = self.model.encode(text, return_type="proto")
        begins = np.array([p.begin for p in proto.pieces], dtype=np.int64)
        if not text.isascii():  # the library's offsets are in bytes
            raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            begins = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))[begins]
        return np.array([p.id for p in proto.pieces], dtype=np.int64), begins

    def short(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self.model.encode([t.decode("utf-8") for t in texts], num_threads=1)]

    def is_stable(self, text: str, p: int) -> bool:
        return self.stable and p >= 2 and text[p - 1] == " " and text[p - 2].isascii() and text[p - 2].isalpha() and text[p].isascii() and text[p].isalpha()


def _encoder(path: str):
    got = words._loaded.get(("counter", path))
    if got is None:
        got = words._loaded["counter", path] = PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)
    return got


def _splice(enc, text: str, left: tuple, left_at: int, right: tuple, right_at: int, end: int) -> int | None:
    """The first proven boundary in [right_at, end) at which both encodings agree, or None."""
    a = left[1] + left_at + enc.shift
    b = right[1] + right_at
    common = [int(p) for p in np.intersect1d(a[a < end], b[b < end]) if 0 < p < len(text) and enc.is_stable(text, int(p))]
    if not common:
        return None
    p, last = common[0], common[-1]
    same = np.array_equal(left[0][(a >= p) & (a < last)], right[0][(b >= p) & (b < last)])
    return p if same else None


def count_long(enc, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """Tokens of a text of any length, never encoding more than a chunk at once unless it must;
    and the encodings it took, those of widened overlaps included."""
    n = len(text)
    if n <= chunk or not enc.stable:
        return len(enc.encode(text)[0]), 1
    start, end = 0, chunk
    left = enc.encode(text[:end])
    done = 1
    total, since = 0, 0  # tokens that begin before ``since`` are counted already
    while end < n:
        wide = overlap
        while True:
            # chunks begin at a boundary, else their first word is cut
            at = max(start + 1, end - wide)
            while at < end and not enc.is_stable(text, at):
                at += 1
            if at < end:
                to = min(n, at + chunk)
                right = enc.encode(text[at:to])
                done += 1
                p = _splice(enc, text, left, start, right, at, end)
                if p is not None and p > since:
                    break
            if end - wide <= start:  # no boundary in all of this chunk: widen it to the right
                end = min(n, end + wide)
                left = enc.encode(text[start:end])
                done += 1
                if end == n:
                    break
            wide *= 2
        if end == n:
            break
        begins = left[1] + start + enc.shift * (left[1] > 0)
        total += int(((begins >= since) & (begins < p)).sum())
        since, start, end, left = p, at, to, right
    begins = left[1] + start + enc.shift * (left[1] > 0)
    return total + int((begins >= since).sum()), done


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, n_chunks) of every row.

    ``n_chunks`` counts the encodings that a text took, 1 for those counted at
    once.  Map-side only: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            buf, off = buffers(batch.column(1))
            raw = buf.tobytes()
            sizes = np.diff(off)
            # at most 4 bytes a character: a short byte length proves a short text
            long = np.flatnonzero(sizes > chunk_chars)
            n_tokens = np.zeros(len(sizes), dtype=np.int64)
            short = np.flatnonzero(sizes <= chunk_chars)
            n_tokens[short] = enc.short([raw[off[i] : off[i + 1]] for i in short])
            chunks = np.ones(len(sizes), dtype=np.int64)
            for i in long:
                t = raw[off[i] : off[i + 1]].decode("utf-8")
                n_tokens[i], chunks[i] = count_long(enc, t, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(chunks)], names=[key, "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("n_chunks", T.LongType())])
    return df.select(key, text).mapInArrow(run, schema)
