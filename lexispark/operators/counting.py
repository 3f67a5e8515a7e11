"""Texts to counted terms, some megabytes at a time.

A chunk of whole documents becomes arrays of term numbers, starts and lengths: Arrow
splits the texts and finds their distinct words, Python sees only these.  One sort of
packed integers groups the tokens by term, document and field.  A chunk's rows leave by
rising term, as one row group of a file, so readers skip by its pages.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext

from ..functions.languages import Language
from ..functions.words import OTHER_BLANKS, Tokens, Words

#: A row per document, field and term; a null term holds each document's field once, with what was left out.
COUNTED = "doc_ref string, field string, doc_boost double, term string, tf long, length long, positions array<struct<start:int,length:int>>"
_SPOTS = pa.list_(pa.field("element", pa.struct([("start", pa.int32()), ("length", pa.int32())])))
_SCHEMA = pa.schema([("doc_ref", pa.string()), ("field", pa.string()), ("doc_boost", pa.float64()), ("term", pa.string()), ("tf", pa.int64()), ("length", pa.int64()), ("positions", _SPOTS)])
#: The same with strings by number, as files take them.
_NAMED = pa.dictionary(pa.int32(), pa.string())
_FILE_SCHEMA = pa.schema([f.with_type(_NAMED) if f.type == pa.string() else f for f in _SCHEMA])

#: Bytes of text of a chunk; rows of a batch for Spark.
CHUNK, ROWS = 8 << 20, 1 << 16

Chunk = tuple[pa.Table, pa.Table, pa.Array, np.ndarray]

_kept: dict[Language, Words] = {}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at least ``CHUNK`` bytes of text, but the last; rows of one ``doc_ref`` stay together."""
    held, size, last = [], 0, None
    for batch in batches:
        refs, start = batch.column(0).to_pylist(), 0
        for k, n in enumerate(pc.binary_length(batch.column(3)).to_pylist()):
            if size >= CHUNK and refs[k] != last:
                held.append(batch.slice(start, k - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, k
            size, last = size + n, refs[k]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many pieces separators part each text into, and these, empty ones as well."""
    for b in OTHER_BLANKS:
        texts = pc.replace_substring(texts, b, " ")
    parts = pc.split_pattern(texts, " ")
    return np.diff(parts.offsets.to_numpy()), parts.values


def _counted(rows: pa.Table, words: Words, tokens: Tokens | None, positions: bool) -> Chunk:
    """A chunk's rows without a term and with one, as files take them; its terms in order, and how many rows each has."""
    words.trim()
    at: dict[tuple, int] = {}
    refs, fields, boosts = (rows.column(k).to_pylist() for k in range(3))
    own = np.array([at.setdefault(key, len(at)) for key in zip(refs, fields)], np.int64)
    e = len(at)
    first = np.unique(own, return_index=True)[1].tolist()
    named = [pa.array([c[k] for k in first], t) for c, t in ((refs, pa.string()), (fields, pa.string()), (boosts, pa.float64()))]
    texts = rows.column(3).combine_chunks()
    if tokens is None:
        counts, raws = _split(texts)
    else:
        found = [tokens(t.as_py()) for t in texts]
        counts = np.array([len(f[0]) for f in found], np.int64)
        raws = pa.array([x for f in found for x in f[0]], pa.string())
    distinct = raws.dictionary_encode()
    by = distinct.indices.to_numpy()
    known = distinct.dictionary.to_pylist()
    ids = np.fromiter(map(words.__getitem__, known), np.int64, len(known))[by]
    who = np.repeat(own, counts)
    keep = ids >= 0
    starts = lengths = None
    if positions:
        if tokens is None:
            lengths = pc.utf8_length(distinct.dictionary).to_numpy()[by]
            ends = np.concatenate([[0], np.cumsum(lengths + 1, dtype=np.int64)])
            bounds = np.concatenate([[0], np.cumsum(counts)])[:-1]
            starts = (ends[:-1] - np.repeat(ends[bounds], counts)).astype(np.int32)
        else:
            starts, lengths = (np.array([x for f in found for x in f[c]], np.int32) for c in (1, 2))
        starts, lengths = starts[keep], lengths[keep]
    left = np.bincount(who[~keep], minlength=e)
    ids, who = ids[keep], who[keep]
    length = np.bincount(who, minlength=e)

    used = np.unique(ids)
    terms = pa.array([words.terms[k] for k in used.tolist()], pa.string())
    order = pc.sort_indices(terms)
    terms, order = terms.take(order), order.to_numpy()
    rank = np.empty(len(words.terms), np.int64)
    rank[used[order]] = np.arange(len(used))
    key, n = rank[ids] * e + who, len(ids)
    bits = n.bit_length()
    if (len(used) * e).bit_length() + bits < 63:
        packed = np.sort(key << bits | np.arange(n))
        by, key = packed & ((1 << bits) - 1), packed >> bits
    else:
        by = np.argsort(key, kind="stable")
        key = key[by]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.empty(0, np.int64)
    term, who = np.divmod(key[heads], max(e, 1))
    tf = np.diff(np.append(heads, n))
    spots = pa.nulls(len(heads), _SPOTS)
    if positions:
        pairs = pa.StructArray.from_arrays([pa.array(starts[by], pa.int32()), pa.array(lengths[by], pa.int32())], fields=list(_SPOTS.value_type))
        spots = pa.ListArray.from_arrays(pa.array(np.append(heads, n), pa.int32()), pairs, type=_SPOTS)

    missing = named[0].is_null().to_numpy(zero_copy_only=False)

    def table(entry: np.ndarray, term: pa.Array, tf: np.ndarray, spots: pa.Array) -> pa.Table:
        ref = pa.DictionaryArray.from_arrays(pa.array(entry, pa.int32(), mask=missing[entry]), named[0].fill_null(""))
        entry = pa.array(entry, pa.int32())
        field = pa.DictionaryArray.from_arrays(entry, named[1])
        return pa.Table.from_arrays([ref, field, named[2].take(entry), term, pa.array(tf, pa.int64()), pa.array(length, pa.int64()).take(entry), spots], schema=_FILE_SCHEMA)

    none = table(np.arange(e), pa.nulls(e, _NAMED), left, pa.nulls(e, _SPOTS))
    rest = table(who, pa.DictionaryArray.from_arrays(pa.array(term, pa.int32()), terms), tf, spots)
    return none, rest, terms, np.bincount(term, minlength=len(used))


def _each(batches: Iterator[pa.RecordBatch], language: Language, alphabet: tuple[str, str], positions: bool) -> Iterator[Chunk]:
    if language not in _kept:
        _kept[language] = Words(language, *alphabet)
    tokens = None if len(language.parts) == 1 and not language.script else Tokens(language)
    for rows in _chunks(batches):
        if rows.num_rows:
            yield _counted(rows, _kept[language], tokens, positions)


def counting(language: Language, alphabet: tuple[str, str], positions: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of (doc_ref, field, doc_boost, text) batches, lower-cased and by ``doc_ref``, that gives ``COUNTED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for none, rest, _, _ in _each(batches, language, alphabet, positions):
            for t in (none, rest):
                yield from t.cast(_SCHEMA).to_batches(max_chunksize=ROWS)

    return run


def writing(language: Language, alphabet: tuple[str, str], positions: bool, uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same into a file a task under ``uri``, which gives (term, df): how many of its rows each chunk's terms have.

    A task that is repeated replaces its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
        path, temporary = f"{root}/part-{TaskContext.get().partitionId():06d}.parquet", f"{root}/_{uuid.uuid4().hex}"
        writer = None
        for none, rest, terms, df in _each(batches, language, alphabet, positions):
            if writer is None:
                out = fs.open_output_stream(temporary)
                writer = pq.ParquetWriter(out, _FILE_SCHEMA, compression="zstd", write_page_index=True, dictionary_pagesize_limit=4 << 20, store_schema=False)
            for t in (none, rest):
                writer.write_table(t, row_group_size=max(1, t.num_rows))
            yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64())], names=["term", "df"])
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, path)

    return run
