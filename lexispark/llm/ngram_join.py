"""N-gram Jaccard join: a blocked sparse product of the incidence matrix.

The matrix has a row per distinct n-gram set (texts with equal sets are one
row with a multiplicity) and a column per n-gram.  Its product with its own
transpose, cell by cell the overlap of two sets, is never formed as a whole:

1.  Sets and sizes are made where texts are read; equal sets collapse to
    classes.  The same pass fills a count sketch of bounded size, which orders
    all n-grams from rare to common.
2.  Only a size-derived prefix of each row in that order goes to the blocks,
    which are hash ranges of columns: a pair at the threshold must share
    ``MIN_SHARE`` of it.  Common n-grams fall out of all but short rows.
3.  Each block forms its part of the product over rows of compatible sizes
    and passes on its non-zero cells, which are added over the blocks.  A
    cell whose sum plus all that the rest of both rows could add is below
    the overlap that the sizes require is dropped.
4.  The rows of the remaining cells are brought together in tiles of bounded
    size, where their overlaps are counted exactly.
5.  Links between classes give neighbours with multiplicities, and connected
    components by star contraction.

Every link is found: 2 and 3 discard by bounds that hold for any two sets,
whatever the sketch says.  A hot text is one class; a hot n-gram is outside
the prefixes; a task sees a block, a tile, or a slice of texts.

Nulls and texts without words have no n-grams and are linked with nothing:
n_similar 0, component_id their own key.  Rows with equal keys are documents
of their own with the same component.  Keys must be integers; a null key
joins its class, whose component_id is the least key that isn't null.  A very
long text is a row like any other.  Only the key and the text are read; other
columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import drop_table, shuffle_partitions, small_side, table
from .components import components
from .kernels import LOWER, U64, chained, mix, ranges, segments, slices, word_hashes, word_spans
from .sketches import PARTS, Sketch, added, bits_for, steps

#: Bytes of a block's incidences, about.
BLOCK_BYTES = 32 << 20
#: Candidate cells of a tile, about.
TILE_PAIRS = 100_000


def shingle_rows(buf: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, and where each row's begin."""
    buf = LOWER[buf]
    _, _, first = word_spans(buf, off)
    h = word_hashes(buf, off)
    sizes = np.diff(first)
    g = chained(h, n)
    rows = []
    f = first.tolist()
    for r, size in enumerate(sizes.tolist()):
        if size >= n:
            x = g[f[r] : f[r] + size - n + 1].copy()
            x.sort()
            if len(x) > 1:
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif size:
            x = np.array([xxhash.xxh3_64_intdigest(h[f[r] : f[r] + size].tobytes(), size)], dtype=U64)
        else:
            x = g[:0]
        rows.append(x)
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    return (np.concatenate(rows) if rows else g[:0]), at


def _signature(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes()) >> 1


def _need(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of a set with any set at the threshold num/den."""
    return -(-num * size // den)


def _sets(df: DataFrame, key: str, text: str, n: int, bits: int) -> DataFrame:
    """A row (key, n_shingles, cls) per document; and the tasks' sketches in parts (block, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        sketch = Sketch(bits)
        seen: set[int] = set()
        for batch in batches:
            for part, buf, off in slices(batch):
                h, at = shingle_rows(buf, off, n)
                sigs, new = [], []
                a = at.tolist()
                for s, e in zip(a[:-1], a[1:]):
                    sig = _signature(h[s:e]) if e > s else None
                    sigs.append(sig)
                    if sig is not None and sig not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(sig)
                        new.append((s, e))
                if new:
                    sketch.add(np.concatenate([h[s:e] for s, e in new]))
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(sigs, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["key", "n_shingles", "cls", "block", "sketch"])
        if sketch.used:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, pa.int64())] * 3, *sketch.parts()], names=["key", "n_shingles", "cls", "block", "sketch"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n_shingles long, cls long, block int, sketch binary")


def _blocks(df: DataFrame, text: str, n: int, sketch, num: int, den: int, n_blocks: int) -> DataFrame:
    """The prefixes' incidences, packed by column block: (block, h, row, cls, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        counts = sketch.value
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cls = np.array([c for c, _, _ in held], dtype=np.int64)
            sizes = np.array([s for _, s, _ in held], dtype=np.int32)
            lens = [len(x) for _, _, x in held]
            h = np.concatenate([x for _, _, x in held])
            row = np.repeat(np.arange(len(held), dtype=np.int32), lens)
            block = (h % U64(n_blocks)).astype(np.int32)
            order = np.argsort(block.astype(np.uint16) if n_blocks <= 65536 else block, kind="stable")
            h, row = h[order], row[order]
            at = np.searchsorted(block[order], np.arange(n_blocks + 1)).tolist()
            out = []
            for b in range(n_blocks):
                s, e = at[b], at[b + 1]
                if s < e:
                    used, local = np.unique(row[s:e], return_inverse=True)
                    out.append((b, h[s:e].tobytes(), local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), cls[used].tobytes(), sizes[used].tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "h", "row", "cls", "size"])

        for batch in batches:
            for _, buf, off in slices(batch):
                h, at = shingle_rows(buf, off, n)
                seldom = steps(h, counts)
                a = at.tolist()
                for s, e in zip(a[:-1], a[1:]):
                    if e == s:
                        continue
                    sig = _signature(h[s:e])
                    if sig in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    m = e - s
                    keep = m - -(-num * m // den) + 1
                    order = np.argsort(seldom[s:e], kind="stable")[:keep]
                    held.append((sig, m, h[s:e][order]))
                    size += keep
                if size > 400_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return df.select(F.col(text).alias("text")).mapInArrow(run, "block int, h binary, row binary, cls binary, size binary")


def _product(blocks: DataFrame, num: int, den: int, n_blocks: int, n_parts: int) -> DataFrame:
    """Non-zero cells of every block's part of the product, packed by the hash of their row."""

    def emit(i: np.ndarray, j: np.ndarray, n: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        part = (mix(ids[i].view(U64).copy()) % U64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        i, j, n = i[order], j[order], n[order]
        cut = np.searchsorted(part[order], np.arange(n_parts + 1)).tolist()
        out = []
        for p in range(n_parts):
            x, y = cut[p], cut[p + 1]
            if x < y:
                used, local = np.unique(np.concatenate([i[x:y], j[x:y]]), return_inverse=True)
                kind = np.uint16 if len(used) < 65536 else np.uint32
                out.append((p, ids[used].tobytes(), sizes[used].astype(np.int32).tobytes(), local.astype(kind).tobytes(), n[x:y].astype(np.uint16 if n[x:y].max() < 65536 else np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "ids", "sizes", "pairs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, ss = [], [], []
        for batch in batches:
            for h, row, cls, size in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                c, s = np.frombuffer(cls, np.int64), np.frombuffer(size, np.int32)
                g = np.frombuffer(h, U64)
                r = np.frombuffer(row, np.uint16 if len(c) < 65536 else np.uint32)
                hs.append(g)
                cs.append(c[r])
                ss.append(s[r])
        if not hs:
            return
        h, c, s = np.concatenate(hs), np.concatenate(cs), np.concatenate(ss)
        del hs, cs, ss
        # columns with one entry have no pair
        order = np.argsort(h, kind="stable")
        h = h[order]
        at = segments(h)
        many = np.repeat(np.diff(at) > 1, np.diff(at))
        order, h = order[many], h[many]
        c, s = c[order], s[order]
        if not len(h):
            return
        # local numbers of the rows, by size: a column's entries from small to large
        ids, where, at_id = np.unique(c, return_index=True, return_inverse=True)
        sizes = s[where].astype(np.int64)
        by_size = np.argsort(sizes, kind="stable")
        ids, sizes = ids[by_size], sizes[by_size]
        rank = np.empty(len(ids), dtype=np.int64)
        rank[by_size] = np.arange(len(ids))
        local = rank[at_id]
        col = np.repeat(np.arange(len(segments(h)) - 1), np.diff(segments(h)))
        key = np.unique(col * len(ids) + local)  # a row seen by two tasks counts once
        col, local = key // len(ids), key % len(ids)
        # partners of an entry: later ones of its column, of at most den/num its size
        top = np.searchsorted(sizes, sizes[local] * den // num, side="right")
        ends = np.searchsorted(key, col * len(ids) + top)
        n_partners = ends - np.arange(len(key)) - 1
        held_k, held_n, k = [], [], 0
        cum = np.concatenate([[0], np.cumsum(n_partners)])
        total = 0
        while k < len(key):
            e = max(k + 1, int(np.searchsorted(cum, cum[k] + 2_000_000, side="right")) - 1)
            m = n_partners[k:e]
            left = np.repeat(np.arange(k, e), m)
            right = left + 1 + ranges(m)
            cell = local[left] * len(ids) + local[right]
            u, n = np.unique(cell, return_counts=True)
            held_k.append(u)
            held_n.append(n)
            total += len(u)
            k = e
            if total > 4_000_000 or k >= len(key):
                u, inv = np.unique(np.concatenate(held_k), return_inverse=True)
                n = np.bincount(inv, np.concatenate(held_n)).astype(np.int64)
                if len(u) > 3_000_000 or k >= len(key):
                    for q in range(0, len(u), 1_000_000):
                        yield emit(u[q : q + 1_000_000] // len(ids), u[q : q + 1_000_000] % len(ids), n[q : q + 1_000_000], ids, sizes)
                    held_k, held_n, total = [], [], 0
                else:
                    held_k, held_n, total = [u], [n], len(u)

    return blocks.repartitionById(n_blocks, F.col("block")).mapInArrow(run, "part int, ids binary, sizes binary, pairs binary, n binary")


def _candidates(cells: DataFrame, num: int, den: int, n_parts: int) -> DataFrame:
    """Pairs (a, b) of rows that the sizes don't rule out, from the cells' sums over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for ids, sizes, pairs, n in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                i, s = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32)
                at = np.frombuffer(pairs, np.uint16 if len(i) < 65536 else np.uint32)
                n = np.frombuffer(n, np.uint16 if len(n) == len(at) else np.uint32)  # two bytes a pair, or four
                x, y = at[: len(n)], at[len(n) :]
                rows.append((i[x], i[y], s[x], s[y], n))
        if not rows:
            return
        a, b, x, y, n = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in range(5))
        del rows
        order = np.lexsort((b, a))
        a, b, x, y, n = a[order], b[order], x[order], y[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        n, a, b, x, y = np.add.reduceat(n, first), a[first], b[first], x[first], y[first]
        # in the common order, all that two rows share beyond the shorter of their
        # prefixes lies in that row's rest, which has _need(size) - 1 n-grams
        rest = _need(np.maximum(x, y), num, den) - 1
        ok = n + rest >= _need(x + y, num, num + den)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return cells.repartitionById(n_parts, F.col("part")).mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, classes: DataFrame, df: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """What the pairs at the threshold come to, a tile at a time: (kind, a, b).

    Kind 0: ``a`` and ``b`` are in one component; kind 1: ``b`` documents are
    linked with those of class ``a``.  A row's text goes to its tiles once,
    compressed, which is smaller than its set.
    """
    import zstandard

    spark = df.sparkSession
    both = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    least = both.groupBy("cls").agg(F.least(F.min("other"), F.first("cls")).alias("near"))
    homed = pairs.join(least.withColumnRenamed("cls", "a"), "a")
    load = homed.groupBy("near").agg(F.count("*").alias("pairs"))
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("pairs") / TILE_PAIRS))).cast("long")
    tiled = table(homed.join(load, "near").select("a", "b", "near", (F.pmod(F.xxhash64("a"), side) * side + F.pmod(F.xxhash64("b"), side)).alias("tile")), "tiles")
    members = tiled.select("near", "tile", F.col("a").alias("cls")).unionByName(tiled.select("near", "tile", F.col("b").alias("cls"))).distinct()
    wanted = table(members.select("cls").distinct().join(classes.select("cls", "rep", "copies"), "cls"), "wanted")
    n_wanted = wanted.count()
    keyed = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    texts = keyed.join(small_side(wanted, n_wanted), F.col("key").eqNullSafe(F.col("rep")))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, buf, off in slices(batch):
                h, at = shingle_rows(buf, off, n)
                raw, o, a = buf.tobytes(), off.tolist(), at.tolist()
                cls = part.column(0).to_pylist()
                # rows that share the representative's key but not its set drop out
                ok = [k for k, c in enumerate(cls) if a[k] < a[k + 1] and _signature(h[a[k] : a[k + 1]]) == c]
                yield pa.RecordBatch.from_arrays([pa.array([cls[k] for k in ok], pa.int64()), part.column(1).take(pa.array(ok, pa.int64())), pa.array([z.compress(raw[o[k] : o[k + 1]]) for k in ok], pa.binary())], names=["cls", "copies", "raw"])

    made = texts.select("cls", "copies", "text").mapInArrow(press, "cls long, copies long, raw binary")
    rows = (
        tiled.select("near", "tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("raw"))
        .unionByName(members.join(made, "cls").select("near", "tile", F.lit(0).alias("kind"), F.col("cls").alias("a"), F.col("copies").alias("b"), "raw"))
        .repartition(shuffle_partitions(spark), "near", "tile")
        .sortWithinPartitions("near", "tile", "kind")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        own: dict[int, tuple] = {}
        asked: dict[int, list] = {}
        z = zstandard.ZstdDecompressor()
        out: list[tuple] = []

        def close() -> None:
            head: dict[int, int] = {}

            def find(x: int) -> int:
                while head.get(x, x) != x:
                    head[x] = head.get(head[x], head[x])
                    x = head[x]
                return x

            linked: dict[int, int] = {}
            for x, ys in asked.items():
                mine, copies = own[x]
                for k in range(0, len(ys), 1000):
                    some = ys[k : k + 1000]
                    lens = np.array([len(own[y][0]) for y in some])
                    other = np.concatenate([own[y][0] for y in some])
                    p = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                    same = np.concatenate([[0], np.cumsum(mine[p] == other)])
                    ends = np.cumsum(lens)
                    common = same[ends] - same[ends - lens]
                    ok = den * common >= num * (len(mine) + lens - common)
                    for y in (y for y, good in zip(some, ok.tolist()) if good):
                        linked[x] = linked.get(x, 0) + own[y][1]
                        linked[y] = linked.get(y, 0) + copies
                        head[find(x)] = find(y)
            out.extend((1, x, n) for x, n in linked.items())
            out.extend((0, x, find(x)) for x in linked if find(x) != x)
            asked.clear()
            own.clear()

        def give() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int8(), pa.int64(), pa.int64()))], names=["kind", "a", "b"])

        for batch in batches:
            near, tile, kind, a, b = (batch.column(k).to_pylist() for k in range(5))
            blobs = batch.column(5)
            for k in range(batch.num_rows):
                if (near[k], tile[k]) != now:
                    close()
                    now = near[k], tile[k]
                if kind[k]:
                    asked.setdefault(a[k], []).append(b[k])
                else:
                    raw = np.frombuffer(z.decompress(blobs[k].as_py()), dtype=np.uint8)
                    own[a[k]] = shingle_rows(raw, np.array([0, len(raw)]), n)[0], b[k]
            yield give()
        close()
        yield give()

    return rows.mapInArrow(count, "kind byte, a long, b long")


def ngram_join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, sketch_bits: int | None = None) -> DataFrame:
    """(key, n_shingles, n_similar, component_id) of every row, linked at Jaccard num/den."""
    spark = df.sparkSession
    if sketch_bits is None:
        sketch_bits = bits_for(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    first = table(_sets(df, key, text, n, sketch_bits), "sets")
    docs = first.where("block is null").select("key", "n_shingles", "cls")
    sketch = spark.sparkContext.broadcast(added(first.where("block is not null").select(F.col("block").alias("part"), "sketch"), sketch_bits))
    classes = table(docs.where("cls is not null").groupBy("cls").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")), "classes")
    entries = (classes.agg(F.sum("n").alias("n")).first()["n"] or 0) * (den - num) / den
    # a pair has a cell in nearly every block: few, of bounded size
    n_blocks = max(1, math.ceil(24 * entries / BLOCK_BYTES))
    n_parts = shuffle_partitions(spark)
    cells = _product(_blocks(df, text, n, sketch, num, den, n_blocks), num, den, n_blocks, n_parts)
    pairs = table(_candidates(cells, num, den, n_parts), "pairs")
    links = table(_exact(pairs, classes, df, key, text, n, num, den), "links")
    drop_table(pairs)
    copies = classes.select("cls", "rep", "copies")
    near = links.where("kind = 1").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("near"))
    parts = components(links.where("kind = 0").select("a", "b")).withColumnRenamed("node", "cls")
    least = parts.join(copies.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("least"))
    linked = parts.join(least, "root").join(near, "cls").select("cls", "near", "least")
    verdict = table(copies.join(linked, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("similar"), F.coalesce("least", "rep").alias("component")).where("similar > 0"), "verdict")
    # rows without a class meet nothing, and stay out of the join
    known = docs.where("cls is not null").join(small_side(verdict, verdict.count()), "cls", "left").select("key", "n_shingles", "similar", "component")
    out = known.unionByName(docs.where("cls is null").select("key", "n_shingles", F.lit(0).alias("similar"), F.col("key").alias("component")))
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component", "key").alias("component_id"))
