"""Removal of repeated byte strings, with suffix arrays over shards.

A byte goes if some string of ``length`` bytes that covers it also starts
anywhere else in the corpus.  Suffix arrays decide that, over shards that
bring together the places that could match:

1.  Places.  The least hash among the ``K``-byte strings of each window of
    ``length`` bytes marks a place; equal windows mark equal places, about
    two in ``length - K`` bytes.  A place carries hashes of four cores, of
    which every window that marks it holds one.
2.  Blocks, which are hash ranges of places, find the places that share a core
    with another one; any other has no repeated window.  A count sketch tells
    which places occur more than ``PLACE_LIMIT`` times; they are salted by
    their cores before they meet.
3.  Shards get the bytes around those places, ordered by place, ``HOT`` of a
    place at most.  Equal ones are one string, which stands for several places.
    The strings' suffix array is induced, and windows that begin one run of
    common prefixes of at least ``length`` bytes at different places are repeated.
4.  Where the surroundings of one place are in several shards, the windows
    left over in each, and one of each run, are matched over all shards by
    their hashes (XXH3).
5.  Repeated windows come back to their texts, where they are merged.

Texts that are equal as a whole (63-bit hash) are one class; if one is as long
as a window, all its rows go entirely.  It isn't compared again with itself,
but its windows count for all others.

Texts are shuffled only where they hold something to compare or to remove,
which a bit table of bounded size tells (its false hits cost a transfer only).

Nulls are empty texts; texts below ``length`` bytes lose nothing; repeated
rows count as copies of each other; very long texts are read whole.  Only the
key and the text are read (``remove_repeats`` passes other columns on), whatever
the others' names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import drop_table, partitions_for, shuffle_partitions, table
from .kernels import Prefix, U64, mix, ranges, segments, slices
from .sketches import PARTS, Sketch, added, bits_for, count_of, steps
from .suffix_array import permuted_lcp, suffix_array

#: Bytes of the strings whose hashes mark places.
K = 32
CORES = 4
#: Surroundings of one place that a shard gets at most.
HOT = 4096
#: Occurrences of a place that meet in one task, about; more are salted.
PLACE_LIMIT = 1_000_000
#: Bytes of a shard's text, about; one place's surroundings stay together.
SHARD_BYTES = 1 << 20
#: 2 ** bits bits tell which texts are wanted: from 20 to 27, about 8 a text.
BLOOM_BITS = (20, 27)

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _text_class(raw: bytes) -> int:
    # as F.xxhash64 has it, without the lowest bit
    return xxhash.xxh64_intdigest(raw, 42) >> 1


def _slide(a: np.ndarray, w: int, op, neutral: int) -> np.ndarray:
    """``op`` over every window of ``w`` elements."""
    n = len(a)
    padded = np.full(-(-n // w) * w, neutral, dtype=a.dtype)
    padded[:n] = a
    rows = padded.reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def places(buf: np.ndarray, off: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """The marked places of all rows: their row, position, hash, windows and cores."""
    n, w = len(buf), length - K + 1
    sizes = np.diff(off)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return None
    prefix = Prefix(buf)
    h = prefix.windows(K)
    valid = np.zeros(n - length + 2, dtype=np.int32)
    np.add.at(valid, off[long], 1)
    np.add.at(valid, off[long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    least = _slide(h, w, np.minimum, (1 << 64) - 1)
    least[~valid] = 0
    around = np.zeros(len(h) + w - 1, dtype=U64)
    around[w - 1 : w - 1 + len(least)] = least
    most = _slide(around, w, np.maximum, 0)
    at = np.flatnonzero((most == h) & (most > 0))
    row = np.searchsorted(off, at, side="right") - 1
    pos = at - off[row]
    # the windows that a place marks are one run of equal least hashes
    run = segments(least)
    mine = np.minimum(np.searchsorted(run, at, side="right") - 1, len(run) - 2)
    seek = np.flatnonzero(least[run[mine]] != h[at])
    while len(seek):
        mine[seek] -= 1
        seek = seek[least[run[mine[seek]]] != h[at[seek]]]
    low = np.minimum(w - 1, at - run[mine])  # they begin from -low ...
    high = np.maximum(0, at - run[mine + 1] + 1)  # ... to -high
    out = {"row": row, "pos": pos, "h": h[at], "low": low, "high": high}
    edges = np.linspace(0, w, CORES + 1).astype(np.int64)
    for k in range(CORES):
        a, b = edges[k], edges[k + 1] - 1  # windows of this core begin from -b to -a
        has = (low >= a) & (high <= b)
        core = np.zeros(len(at), dtype=U64)
        core[has] = prefix.of(at[has] - a, at[has] - b + length)
        out[f"core{k}"] = np.where(has, np.maximum(core >> U64(32), 1), 0).astype(np.uint32)
    return out


_PLACE = [("h", np.uint64), ("row", np.uint16), ("pos", np.uint32), ("low", np.uint8), ("high", np.uint8), *[(f"core{k}", np.uint32) for k in range(CORES)]]


def _marked(df: DataFrame, text: str, length: int, n_blocks: int, bits: int) -> DataFrame:
    """Places packed by block: (block, data, cls), ``data`` being the columns of _PLACE; and
    the tasks' sketches in parts (part, sketch)."""
    # "low" and "high" need a byte each: length - K < 256
    if length - K > 255:
        raise ValueError("length is at most K + 255")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        seen: set[int] = set()
        sketch = Sketch(bits)
        for batch in batches:
            for _, buf, off in slices(batch):
                raw, o = buf.tobytes(), off.tolist()
                cls = np.array([_text_class(raw[a:b]) for a, b in zip(o[:-1], o[1:])], dtype=np.int64)
                new = [k for k, c in enumerate(cls.tolist()) if o[k + 1] - o[k] >= length and c not in seen and not seen.add(c)]
                if len(seen) > 1_000_000:
                    seen.clear()
                for s in range(0, len(new), 60_000):
                    rows = np.array(new[s : s + 60_000])
                    size = off[rows + 1] - off[rows]
                    mine = buf if len(rows) == len(cls) else buf[np.repeat(off[rows], size) + ranges(size)]
                    got = places(mine, np.concatenate([[0], np.cumsum(size)]), length)
                    if got is None:
                        continue
                    sketch.add(got["h"])
                    block = (got["h"] % U64(n_blocks)).astype(np.int64)
                    order = np.argsort(block.astype(np.uint16) if n_blocks < 65536 else block, kind="stable")
                    cut = np.searchsorted(block[order], np.arange(n_blocks + 1)).tolist()
                    cols = {c: got[c][order] for c, _ in _PLACE}
                    own = cls[rows]
                    out = []
                    for b in range(n_blocks):
                        x, y = cut[b], cut[b + 1]
                        if x < y:
                            out.append((b, *_packed({c: v[x:y] for c, v in cols.items()}, own)))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())], names=names)
        if sketch.used:
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, pa.int32()), pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.binary()), *sketch.parts()], names=names)

    names = ["block", "data", "cls", "part", "sketch"]
    return df.select(F.col(text).alias("text")).mapInArrow(run, "block int, data binary, cls binary, part int, sketch binary")


def _packed(cols: dict[str, np.ndarray], own: np.ndarray) -> tuple[bytes, bytes]:
    """Places and the classes of their texts, ``own`` by row."""
    used, local = np.unique(cols["row"], return_inverse=True)
    return b"".join((local if c == "row" else cols[c]).astype(t).tobytes() for c, t in _PLACE), own[used].tobytes()


def _unpack(data: bytes, cls: bytes) -> dict[str, np.ndarray]:
    n = len(data) // sum(np.dtype(t).itemsize for _, t in _PLACE)
    out, at = {}, 0
    for c, t in _PLACE:
        size = n * np.dtype(t).itemsize
        out[c] = np.frombuffer(data, dtype=t, count=n, offset=at)
        at += size
    out["cls"] = np.frombuffer(cls, dtype=np.int64)[out.pop("row")]
    return out


def _salted(marked: DataFrame, sketch, n_blocks: int) -> DataFrame:
    """Packed places again, those that the sketch finds too frequent spread over blocks by their cores."""
    limit = PLACE_LIMIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, cls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _unpack(data, cls)
                block = _salts(x, sketch.value, limit) % n_blocks
                own, x["row"] = np.unique(x.pop("cls"), return_inverse=True)
                order = np.argsort(block, kind="stable")
                cut = segments(block[order]).tolist()
                out = [(int(block[order[a]]), *_packed({c: v[order[a:b]] for c, v in x.items()}, own)) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["block", "data", "cls"])

    return marked.select("data", "cls").mapInArrow(run, "block int, data binary, cls binary")


def _salts(x: dict[str, np.ndarray], sketch: np.ndarray | None, limit: int) -> np.ndarray:
    """What places must have in common to meet: their hash, or if it is too frequent also a salt of their cores."""
    out = (x["h"] >> U64(1)).astype(np.int64)
    if sketch is not None:
        n_salts = np.ceil(count_of(steps(x["h"], sketch)) / limit).astype(np.int64)
        hot = np.flatnonzero(n_salts > 1)
        if len(hot):
            core = sum(x[f"core{k}"][hot].astype(U64) << U64(8 * k) for k in range(CORES))
            salt = (mix(core.copy()) % n_salts[hot].astype(U64)).astype(U64)
            out[hot] = (mix(x["h"][hot] + salt * U64(0x9E3779B97F4A7C15)) >> U64(1)).astype(np.int64)
    return out


def _found(marked: DataFrame, length: int, n_blocks: int, sketch=None) -> DataFrame:
    """(cls, open, start, end, h) of the stretches to compare; ``open`` where a place's stretches
    are in several groups, which ``h`` numbers."""
    limit = PLACE_LIMIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(d, c) for batch in batches for d, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if not parts:
            return
        x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        del parts
        counts = None if sketch is None else sketch.value
        x["meet"] = _salts(x, counts, limit)
        salted = np.zeros(len(x["h"]), dtype=bool) if counts is None else x["meet"] != (x["h"] >> U64(1)).astype(np.int64)
        # places alone are out, but salted ones may have others elsewhere
        order = np.argsort(x["meet"], kind="stable")
        at = segments(x["meet"][order])
        order = order[np.repeat(np.diff(at) > 1, np.diff(at)) | salted[order]]
        x = {c: v[order] for c, v in x.items()}
        if not len(x["h"]):
            return
        order = np.lexsort((x["pos"], x["cls"], x["h"], x["meet"]))
        x = {c: v[order] for c, v in x.items()}
        new = np.ones(len(x["h"]), dtype=bool)
        new[1:] = (x["meet"][1:] != x["meet"][:-1]) | (x["h"][1:] != x["h"][:-1]) | (x["cls"][1:] != x["cls"][:-1]) | (x["pos"][1:] != x["pos"][:-1])
        x = {c: v[new] for c, v in x.items()}
        salted = np.zeros(len(x["h"]), dtype=bool) if counts is None else x["meet"] != (x["h"] >> U64(1)).astype(np.int64)
        edge = np.ones(len(x["h"]), dtype=bool)
        edge[1:] = (x["meet"][1:] != x["meet"][:-1]) | (x["h"][1:] != x["h"][:-1])
        group = np.cumsum(edge) - 1
        pos, low, high = (x[c].astype(np.int64) for c in ("pos", "low", "high"))
        # the windows of cores that another place of the group shares; of salted places, all
        edges = np.linspace(0, length - K + 1, CORES + 1).astype(np.int64)
        far = np.where(salted, low, -1)
        near = np.where(salted, high, 1 << 20)
        for k in range(CORES):
            core = x[f"core{k}"]
            has = np.flatnonzero(core > 0)
            if not len(has):
                continue
            by = has[np.lexsort((core[has], group[has]))]
            edge = np.ones(len(by), dtype=bool)
            edge[1:] = (core[by][1:] != core[by][:-1]) | (group[by][1:] != group[by][:-1])
            size = np.diff(np.append(np.flatnonzero(edge), len(by)))
            hit = by[np.repeat(size > 1, size)]
            far[hit] = np.maximum(far[hit], np.minimum(edges[k + 1] - 1, low[hit]))
            near[hit] = np.minimum(near[hit], np.maximum(edges[k], high[hit]))
        go = np.flatnonzero(far >= 0)
        if not len(go):
            return
        # a place's stretches in parts of HOT, those with equal cores together
        go = go[np.lexsort((*[x[f"core{k}"][go] for k in range(CORES)], group[go]))]
        at = segments(group[go])
        size = np.diff(at)
        part = ranges(size) // HOT
        apart = salted[go] | np.repeat(size > HOT, size)
        h = np.where(apart, (mix(x["meet"][go].view(U64) + part.astype(U64) * U64(0xD6E8FEB86659FD93)) >> U64(1)).view(np.int64), x["meet"][go])
        yield pa.RecordBatch.from_arrays([pa.array(x["cls"][go]), pa.array(apart), pa.array((pos[go] - far[go]).astype(np.int32)), pa.array((pos[go] - near[go] + length).astype(np.int32)), pa.array(h)], names=["cls", "open", "start", "end", "h"])

    return marked.select("block", "data", "cls").repartitionById(n_blocks, F.col("block")).mapInArrow(run, "cls long, open boolean, start int, end int, h long")


def _bloom_bits(n: int) -> int:
    low, high = BLOOM_BITS
    return min(high, max(low, (8 * n).bit_length()))


def _bits(df: DataFrame, column: str, bits: int):
    """A broadcast bit table of a long column's values, of 2 ** bits bits."""
    import zstandard

    spark = df.sparkSession
    n_parts = 16
    shift = 63 - bits

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            held[batch.column(0).to_numpy() >> shift] = True
        packed = np.packbits(held)
        step = len(packed) // n_parts
        yield pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), pa.array([zstandard.compress(packed[k * step : (k + 1) * step].tobytes(), 1) for k in range(n_parts)], pa.binary())], names=["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
                held[p] = held[p] | got if p in held else got
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "bits"])

    got = df.select(column).mapInArrow(mark, "part int, bits binary").repartition(n_parts, "part").mapInArrow(join, "part int, bits binary").collect()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    step = len(out) // n_parts
    for r in got:
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(out)


def _wanted(bits_table: np.ndarray, bits: int, cls: np.ndarray) -> np.ndarray:
    at = cls >> (63 - bits)
    return (bits_table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _texts(df: DataFrame, text: str, wanted, bits: int) -> DataFrame:
    """(cls, raw) of the texts that the bit table wants, once a task, compressed."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        seen: set[int] = set()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for _, buf, off in slices(batch):
                raw, o = buf.tobytes(), off.tolist()
                cls = np.array([_text_class(raw[a:b]) for a, b in zip(o[:-1], o[1:])], dtype=np.int64)
                rows = [k for k in np.flatnonzero(_wanted(wanted.value, bits, cls)).tolist() if int(cls[k]) not in seen and not seen.add(int(cls[k]))]
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), pa.array([press.compress(raw[o[k] : o[k + 1]]) for k in rows], pa.binary())], names=["cls", "raw"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "cls long, raw binary")


def _with_texts(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Each text's row before the stretches of it, a class after another: (cls, first, raw, ...)."""
    extra = [c for c in rows.columns if c != "cls"]
    a = texts.select("cls", F.lit(0).alias("late"), "raw", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra])
    b = rows.select("cls", F.lit(1).alias("late"), F.lit(None).cast("binary").alias("raw"), *extra)
    return a.unionByName(b).repartition(n, "cls").sortWithinPartitions("cls", "late")


def _bytes_around(stretches: DataFrame, n_shards: int) -> DataFrame:
    """The bytes of stretches to compare: (shard, h, cls, start, open, data)."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw = None, b""
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            cls, late, blob, apart, start, end, h = (batch.column(k) for k in range(7))
            cls, late, apart, start, end, h = (c.to_pylist() for c in (cls, late, apart, start, end, h))
            out = []
            for k in range(batch.num_rows):
                if not late[k]:
                    if cls[k] != now:
                        now, raw = cls[k], press.decompress(blob[k].as_py())
                elif cls[k] == now:
                    out.append((h[k] % n_shards, h[k], now, start[k], apart[k], raw[start[k] : end[k]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["shard", "h", "cls", "start", "open", "data"])

    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return stretches.mapInArrow(run, "shard int, h long, cls long, start int, open boolean, data binary")


#: Letters of bytes: UTF-8 has 243 of them; 1 to SEPARATORS end regions in turn, 0 the text.
SEPARATORS = 12
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[[b for b in range(256) if b not in (0xC0, 0xC1) and b < 0xF5]] = np.arange(1 + SEPARATORS, 256)


def repeated_in_shard(regions: list[bytes], cls: np.ndarray, start: np.ndarray, length: int, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Region and begin (within it) of the windows that also begin elsewhere in the shard, and the run they are in.

    ``cls`` and ``start`` tell where a region is; of a region with ``copies`` above 1, where one of them is.
    """
    sizes = np.array([len(r) for r in regions], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.append(_LETTER[np.frombuffer(b"\xff".join(regions) + b"\xff", dtype=np.uint8)], np.uint8(0))
    t[begins[1:] - 1] = 1 + np.arange(len(regions)) % SEPARATORS
    sa = suffix_array(t)
    _, lcp = permuted_lcp(t, sa, begins[:-1], int(sizes.max()) + length)
    run = np.cumsum(lcp[sa] < length)
    # the suffixes that begin with a window, and aren't alone in their run
    windows = np.maximum(0, sizes - length + 1)
    begin = np.zeros(len(t), dtype=bool)
    begin[np.repeat(begins[:-1], windows) + ranges(windows)] = True
    ok = begin[sa]
    sa, run = sa[ok], run[ok]
    region = np.repeat(np.arange(len(regions), dtype=np.int32), sizes + 1)[sa]
    same = run[1:] == run[:-1]
    some = np.zeros(len(run), dtype=bool)
    some[1:] |= same
    some[:-1] |= same
    if copies is not None:
        some |= copies[region] > 1
    sa, run, region = sa[some], run[some], region[some]
    inside = sa - begins[region]
    if not len(run):
        return region, inside, run
    # a run is a repeat if its windows begin at two places of the corpus at least
    place = start[region] + inside
    order = np.lexsort((place, cls[region], run))
    r, c, p = run[order], cls[region][order], place[order]
    new = np.ones(len(r), dtype=np.int64)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    if copies is not None:
        new += copies[region][order] - 1
    at = segments(r)
    many = np.repeat(np.add.reduceat(new, at[:-1]) > 1, np.diff(at))
    return region[order][many], inside[order][many], r[many]


def _stretches(cls: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` at the given begins, merged: class, start, end."""
    if not len(cls):
        return cls, begin, begin
    order = np.lexsort((begin, cls))
    cls, begin = cls[order], begin[order]
    new = np.ones(len(cls), dtype=bool)
    new[1:] = (cls[1:] != cls[:-1]) | (begin[1:] > begin[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(cls)) - 1
    return cls[first], begin[first], begin[last] + length


def _left_over(regions: list[bytes], apart: np.ndarray, length: int, region: np.ndarray, inside: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, region and begin of the windows of open regions that aren't repeated in the shard, and of one of each run."""
    sizes = np.where(apart, np.array([len(r) for r in regions], dtype=np.int64) - length + 1, 0)
    at = np.concatenate([[0], np.cumsum(sizes)])
    todo = np.ones(at[-1], dtype=bool)
    mine = apart[region]
    region, inside, run = region[mine], inside[mine], run[mine]
    todo[at[region] + inside] = False
    if len(run):
        first = segments(run)[:-1]
        todo[at[region[first]] + inside[first]] = True
    window = np.flatnonzero(todo)
    of = np.searchsorted(at, window, side="right") - 1
    begin = window - at[of]
    h = np.fromiter((xxhash.xxh3_64_intdigest(regions[r][b : b + length]) for r, b in zip(of.tolist(), begin.tolist())), dtype=U64, count=len(of))
    return h, of, begin


def _compared(around: DataFrame, length: int, n_shards: int) -> DataFrame:
    """(cls, start, end) that the shards' suffix arrays find repeated; and the windows of open
    stretches that they leave over, packed (part, data)."""
    names = ["cls", "start", "end", "part", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        # equal regions are one, in several places
        held: dict[tuple, list] = {}
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            regions, apart = [d for d, _ in held], np.array([a for _, a in held], dtype=bool)
            members = [sorted(set(x)) for x in held.values()]
            held.clear()
            copies = np.array([len(x) for x in members], dtype=np.int64)
            cls, start = (np.array([x[0][k] for x in members], dtype=np.int64) for k in range(2))
            region, inside, runs = repeated_in_shard(regions, cls, start, length, copies)
            r, s, e = _stretches(region, inside, length)
            n = copies[r]
            c, at = (np.array([x[k] for j in r.tolist() for x in members[j]], dtype=np.int64) for k in range(2))
            s, e = np.repeat(s, n) + at, np.repeat(e, n) + at
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.nulls(len(c), pa.int32()), pa.nulls(len(c), pa.binary())], names=names)
            if not apart.any():
                return
            h, of, begin = _left_over(regions, apart, length, region, inside, runs)
            part = (h % U64(n_shards)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, c, p, part = h[order], cls[of][order], (start[of] + begin)[order].astype(np.int32), part[order]
            cut = segments(part).tolist()
            out = [(int(part[a]), h[a:b].tobytes() + c[a:b].tobytes() + p[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
            m = len(out)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.array([a for a, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=names)

        for batch in batches:
            h, cls, start, apart, data = (batch.column(k).to_pylist() for k in range(1, 6))
            for k in range(batch.num_rows):
                if size > SHARD_BYTES and h[k] != last:
                    yield from flush()
                    size = 0
                own = held.setdefault((data[k], apart[k]), [])
                if not own:
                    size += len(data[k])
                own.append((cls[k], start[k]))
                last = h[k]
        if held:
            yield from flush()

    shards = around.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("h")
    return shards.mapInArrow(run, "cls long, start int, end int, part int, data binary")


def _matched(left: DataFrame, length: int, n_parts: int) -> DataFrame:
    """(cls, start, end) of the windows left over in one shard that another shard has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[tuple] = []
        for batch in batches:
            for data in batch.column(1).to_pylist():
                n = len(data) // 20
                hot.append((np.frombuffer(data, dtype=U64, count=n), np.frombuffer(data, dtype=np.int64, count=n, offset=8 * n), np.frombuffer(data, dtype=np.int32, offset=16 * n)))
        if not hot:
            return
        g, c, p = (np.concatenate([x[k] for x in hot]) for k in range(3))
        order = np.lexsort((p, c, g))
        g, c, p = g[order], c[order], p[order].astype(np.int64)
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])
        at = segments(g)
        many = np.repeat(np.add.reduceat(new.astype(np.int64), at[:-1]) > 1, np.diff(at))
        if many.any():
            c, s, e = _stretches(c[many], p[many], length)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["cls", "start", "end"])

    return left.select("part", "data").repartitionById(n_parts, F.col("part")).mapInArrow(run, "cls long, start int, end int")


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes that go, and the runs they form."""
    spans.sort()
    kept, at, runs, gone = [], 0, 0, 0
    end = -1
    for s, e in spans:
        if s > end:
            runs += 1
            kept.append(raw[at:s])
        if e > end:
            gone += e - max(s, end)
            at = end = e
    kept.append(raw[at:])
    return b"".join(kept), gone, runs


def _verdicts(spans: DataFrame, texts: DataFrame, n: int, with_text: bool) -> DataFrame:
    """(cls, n_removed, n_spans, kept_sha256[, kept]) of every text with repeated bytes."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, own = None, b"", []
        press = zstandard.ZstdDecompressor()
        out: list[tuple] = []

        def close() -> None:
            if own:
                kept, gone, runs = _cut(press.decompress(raw), own)
                out.append((now, gone, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))

        def give() -> pa.RecordBatch:
            rows = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["cls", "n_removed", "n_spans", "kept_sha256", "kept"])

        for batch in batches:
            cls, late, start, end = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for k in range(batch.num_rows):
                if cls[k] != now:
                    close()
                    now, raw, own = cls[k], b"", []
                if not late[k]:
                    raw = batch.column(2)[k].as_py()
                elif own and start[k] == own[-1][1]:
                    own[-1] = (own[-1][0], end[k])
                else:
                    own.append((start[k], end[k]))
            yield give()
        close()
        if out:
            yield give()

    return _with_texts(spans.select("cls", "start", "end"), texts, n).mapInArrow(run, "cls long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _docs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cls, n_bytes, sha) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch):
                raw, o = buf.tobytes(), off.tolist()
                cut = [raw[a:b] for a, b in zip(o[:-1], o[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_text_class(x) for x in cut], pa.int64()), pa.array(np.diff(off)), pa.array([hashlib.sha256(x).hexdigest() for x in cut], pa.string())], names=[key, "cls", "n_bytes", "sha"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("cls", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("sha", T.StringType())])
    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


def _repeats(df: DataFrame, text: str, length: int, total: int, with_text: bool) -> DataFrame:
    """(cls, n_removed, n_spans, kept_sha256[, kept]) of texts with repeated bytes, a table."""
    spark = df.sparkSession
    n_blocks = partitions_for(spark, total * 2 / (length - K) * 40)
    bits = bits_for(total)
    packed = table(_marked(df, text, length, n_blocks, bits), "marked")
    sketch = added(packed.where("part is not null").select("part", "sketch"), bits)
    marked, shared = packed.where("part is null"), None
    if count_of(sketch.max()) > PLACE_LIMIT:
        shared = spark.sparkContext.broadcast(sketch)
        marked = _salted(marked, shared, n_blocks)
    todo = table(_found(marked, length, n_blocks, shared), "places")
    drop_table(packed)
    n, load = todo.agg(F.count("*"), F.sum((F.col("end") - F.col("start")).cast("long"))).first()
    n_shards = partitions_for(spark, load or 0, 16 << 20)
    n_texts = partitions_for(spark, total / 2)
    bloom = _bloom_bits(n)
    wanted = _bits(todo, "cls", bloom)
    around = _bytes_around(_with_texts(todo, _texts(df, text, wanted, bloom), n_texts), n_shards)
    compared = table(_compared(around, length, n_shards), "compared")
    matched = _matched(compared.where("part is not null"), length, n_shards)
    spans = table(compared.where("part is null").select("cls", "start", "end").unionByName(matched), "spans")
    bloom = _bloom_bits(spans.count())
    touched = _bits(spans, "cls", bloom)
    out = table(_verdicts(spans, _texts(df, text, touched, bloom), n_texts, with_text), "verdicts")
    for t in (todo, compared, spans):
        drop_table(t)
    return out


def suffix_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    docs = table(_docs(df, key, text), "docs")
    total = docs.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    verdicts = _repeats(df, text, length, total, False).drop("kept")
    copied = docs.where(F.col("n_bytes") >= length).groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1")
    known = verdicts.join(copied, "cls", "full_outer")
    out = docs.join(known, "cls", "left")
    whole = F.col("copies").isNotNull()
    return out.select(
        key,
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def remove_repeats(df: DataFrame, text: str = "text", length: int = 200, chars: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with repeated bytes removed from their texts.

    A character that a cut leaves incomplete goes as well.  ``chars``, if a
    column of that name is there, becomes the new text's code points.  Rows
    of texts without repeats pass unchanged and unshuffled; those that go
    entirely stay as empty texts.
    """
    spark = df.sparkSession
    own = df.withColumn("__lx_cls", _class_of(F.col(text)))
    sized = own.select("__lx_cls", F.octet_length(text).cast("long").alias("n"))
    total = sized.agg(F.sum("n").alias("n")).first()["n"] or 0
    verdicts = _repeats(df, text, length, total, True).select(F.col("cls").alias("__lx_cls"), "kept")
    copied = sized.where(F.col("n") >= length).groupBy("__lx_cls").agg(F.count("*").alias("c")).where("c > 1").select("__lx_cls", F.lit(b"").alias("kept"))
    known = table(verdicts.join(copied.select("__lx_cls"), "__lx_cls", "left_anti").unionByName(copied), "known")
    bloom = _bloom_bits(known.count())
    bits = _bits(known, "__lx_cls", bloom)

    @F.pandas_udf("boolean")
    def touched(cls):
        import pandas as pd

        return pd.Series(_wanted(bits.value, bloom, cls.to_numpy()))

    @F.pandas_udf("string")
    def readable(kept):
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    same = own.where(~touched("__lx_cls")).select(*df.columns)
    n = shuffle_partitions(spark)
    hit = own.where(touched("__lx_cls")).repartition(n, "__lx_cls").join(known.withColumn("__lx_hit", F.lit(True)), "__lx_cls", "left").withColumn("__lx_new", readable("kept"))
    new = F.when(F.col("__lx_hit"), F.col("__lx_new")).otherwise(F.col(text))
    cols = [new.alias(c) if c == text else F.when(F.col("__lx_hit"), F.length("__lx_new").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == chars else F.col(c) for c in df.columns]
    return same.unionByName(hit.select(*cols))


def _class_of(column):
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(column, F.lit(""))), 1)
