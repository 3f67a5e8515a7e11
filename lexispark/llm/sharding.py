"""Sharding by histogram sort.

Rows are ordered by (hash of the text, key), so equal texts lie together.
Splitters that cut the order into ranges of equal bytes are found before any
row moves: candidate boundaries divide each splitter's interval, every task
counts the exact bytes and rows below each, the counts are added, and the
interval around the target is divided again, until a boundary is within the
tolerance or only one text is left.  Equal texts stay together if the nearer
end of their group is within ``GROUP_TOLERANCE`` of a shard's bytes; else the
group is split by key in the same way.  Then rows are exchanged once.

The counts tell how many rows precede each range, so a row's slot is that
number plus its place in its range, and no shard is ever in one task: there
are as many ranges a shard as its rows need.

Law: ``bytes``.  Null texts have no bytes and one hash; null keys come first;
rows equal in text and key go to the same shard.  A very long text is one row
of its size.  Other columns are ignored, whatever their names, but those to
``keep``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .kernels import U64

#: Shares of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.001
GROUP_TOLERANCE = 0.01
#: Rows of a range, about.
RANGE_ROWS = 1_000_000
#: Boundaries counted at once, over all splitters.
PROBES = 1 << 15

_TOP = 1 << 64


def _unsigned(x: np.ndarray) -> np.ndarray:
    """Longs in their order as unsigned numbers."""
    return x.view(U64) ^ U64(1 << 63)


def _count(rows: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each of the sorted boundaries; ``rows`` is (x, size)."""
    at = np.array(probes, dtype=U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(at) + 1, dtype=np.int64), np.zeros(len(at) + 1, dtype=np.int64)
        for batch in batches:
            x = _unsigned(batch.column(0).to_numpy().copy())
            cell = np.searchsorted(at, x, side="right")
            np.add.at(size, cell, batch.column(1).to_numpy())
            n += np.bincount(cell, minlength=len(at) + 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(n[used])], names=["cell", "size", "n"])

    got = rows.mapInArrow(run, "cell long, size long, n long").groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, n = np.zeros(len(at) + 1, dtype=np.int64), np.zeros(len(at) + 1, dtype=np.int64)
    for r in got:  # one row a boundary
        size[r["cell"]], n[r["cell"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def _split(rows: DataFrame, targets: list[float], tolerance: float, total: tuple[int, int]) -> list[dict]:
    """For each target a boundary (``at``, bytes and rows below it), or the one
    value (``value``) that holds the target, with bytes and rows below and in it."""
    state = [{"lo": 0, "hi": _TOP, "below": (0, 0), "upto": total} for _ in targets]
    done: list[dict | None] = [None] * len(targets)
    while any(d is None for d in done):
        todo = sorted({(s["lo"], s["hi"]) for s, d in zip(state, done) if d is None})
        each = max(4, min(256, PROBES // len(todo)))
        probes = sorted({lo + (hi - lo) * k // each for lo, hi in todo for k in range(1, each)} | {hi for _, hi in todo if hi < _TOP} | {lo for lo, _ in todo if lo > 0})
        size, n = _count(rows, probes)
        at = np.array(probes, dtype=object)
        for k, (s, target) in enumerate(zip(state, targets)):
            if done[k] is not None:
                continue
            inside = [j for j in range(np.searchsorted(at, s["lo"], side="left"), np.searchsorted(at, s["hi"], side="right"))]
            below = [(int(size[j]), int(n[j]), probes[j]) for j in inside]
            best = min(below, key=lambda b: abs(b[0] - target), default=None)
            if best is not None and abs(best[0] - target) <= tolerance:
                done[k] = {"at": best[2], "below": best[:2]}
                continue
            for b in below:
                if b[0] <= target and b[2] >= s["lo"]:
                    s["lo"], s["below"] = b[2], b[:2]
                elif b[0] > target and b[2] <= s["hi"]:
                    s["hi"], s["upto"] = b[2], b[:2]
                    break
            if s["hi"] - s["lo"] <= 1:
                done[k] = {"value": s["lo"], "below": s["below"], "upto": s["upto"]}
    return done


def splitters(docs: DataFrame, n_ranges: int, n_shards: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted (hash, d) boundaries between ranges of (hash, d, size), as unsigned numbers; rows below each."""
    total, n = docs.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return [], []
    tolerance *= total / n_shards
    targets = [total * k / n_ranges for k in range(1, n_ranges)]
    got = []
    hot: dict[int, list] = {}  # by text: what is to be split by key
    for target, s in zip(targets, _split(docs.select("hash", "size"), targets, tolerance, (total, n))):
        if "at" in s:
            got.append(((s["at"], 0), s["below"][1]))
            continue
        (below, rows), (upto, rows_upto) = s["below"], s["upto"]
        edge = min((target - below, (s["value"], 0), rows), (upto - target, (s["value"] + 1, 0), rows_upto))
        if edge[0] > group_tolerance * total / n_shards:
            hot.setdefault(s["value"], []).append((target, edge, s))
        else:
            got.append((edge[1], edge[2]))
    for value, asked in hot.items():
        # one text's copies: all their splitters are refined in the same scans
        signed = (value ^ (1 << 63)) - (_TOP if value ^ (1 << 63) >= 1 << 63 else 0)
        copies = docs.where(F.col("hash") == F.lit(signed)).select("d", "size")
        (below, rows), (upto, rows_upto) = asked[0][2]["below"], asked[0][2]["upto"]
        found = _split(copies, [target - below for target, _, _ in asked], tolerance, (upto - below, rows_upto - rows))
        for (target, edge, _), t in zip(asked, found):
            ends = [(t["at"], t["below"])] if "at" in t else [(t["value"], t["below"]), (t["value"] + 1, t["upto"])]
            for d, (b, r) in ends:
                edge = min(edge, (abs(below + b - target), (value, min(d, _TOP - 1)), rows + r))
            got.append((edge[1], edge[2]))
    got.sort()
    return [g[0] for g in got], [g[1] for g in got]


def placed(cuts: list[tuple[int, int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of the longs (hash, d): the range they are in."""
    hs, ds = np.array([h for h, _ in cuts], dtype=U64), np.array([d for _, d in cuts], dtype=U64)

    def place(hash_: np.ndarray, d: np.ndarray) -> np.ndarray:
        h, x = _unsigned(hash_.astype(np.int64)), _unsigned(d.astype(np.int64))
        out = np.searchsorted(hs, h, side="left")
        # past boundaries of equal hash as long as d isn't below theirs
        while True:
            more = out < len(hs)
            at = np.minimum(out, max(0, len(hs) - 1))
            more = more & (hs[at] == h) & (ds[at] <= x) if len(hs) else more
            if not more.any():
                return out.astype(np.int32)
            out = out + more

    return place


def shard(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, *keep) of every row."""
    docs = table(
        df.select(
            F.col(key).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
            (F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))).alias("d"),
            *keep,
        ),
        "rows",
    )
    n = docs.count()
    per = max(1, -(-n // (n_shards * RANGE_ROWS)))
    n_ranges = n_shards * per
    cuts, below = splitters(docs, n_ranges, n_shards)
    below = [0, *below]
    at = placed(cuts)

    @F.pandas_udf("int")
    def place(hash_, d):
        import pandas as pd

        return pd.Series(at(hash_.to_numpy(), d.to_numpy()))

    ranged = docs.withColumn("range", place("hash", "d")).repartitionById(n_ranges, F.col("range")).sortWithinPartitions("range", "hash", "d")
    kept = [f for f in docs.schema.fields if f.name in keep]
    names = ["key", "size", "text_crc32", *[f.name for f in kept], "shard", "slot"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_: dict[int, int] = {}
        for batch in batches:
            r = batch.column(batch.schema.get_field_index("range")).to_numpy()
            slot = np.empty(len(r), dtype=np.int64)
            for k in np.unique(r).tolist():
                mine = np.flatnonzero(r == k)
                first = next_.get(k, below[k] - below[k // per * per])
                slot[mine] = first + np.arange(len(mine))
                next_[k] = first + len(mine)
            own = [batch.column(batch.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array((r // per).astype(np.int32)), pa.array(slot)], names=names)

    from pyspark.sql import types as T

    schema = T.StructType([*[docs.schema[c] for c in names[:-2]], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = ranged.mapInArrow(number, schema)
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *keep)
