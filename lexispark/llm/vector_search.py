"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of near length, longest first; a bucket is a
part of the table and is never shuffled against the queries.  The queries go
past each bucket in blocks read from the shared folder, so a task holds one
block and one chunk of vectors.  A first bound for every query's k-th score
comes from the longest vectors; it rises as chunks are searched.

For a query with bound b, a chunk can only matter where length * |query| is
at least b.  The local cosine threshold b / (|query| * the chunk's longest)
decides for each pair of query and chunk:

*  nothing is searched, if the threshold is above 1;
*  lengths: the longest vectors that can reach b are multiplied;
*  coordinates: the query's largest coordinates give a partial product, the
   rest is bounded by the lengths of the two rests, and only vectors that
   reach b are verified.  How many coordinates, and whether that takes fewer
   multiplications than lengths, is estimated from ``PROBES`` vectors of the
   chunk, whose partial products show which share would be left to verify.

``report`` counts the cells that each way passes, prunes and verifies.

Products are exact: sums of integers that double precision holds; where the
lengths' product could exceed 2 ** 53, 64-bit integers are used, and Python's
where it could exceed 2 ** 63.

Vectors that are null or hold a null or non-finite component take no part; all
others do, however large.  Candidates of another dimension than the query's
take no part in its search.  Rows that share the query's id are the query's
own.  Ties go to the smaller id; with fewer than k candidates all are returned.
Scores beyond a long's range are pinned to it, and then tie.  Other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_folder, partitions_for, table

#: Vectors of a chunk whose partial products estimate what pruning leaves.
PROBES = 64
#: Queries of a block, vectors that a task holds, those of a chunk, and long vectors for the first bound.
BLOCK = 1024
HELD = 1 << 15
CHUNK = 1 << 12
LONGEST = 2048
#: Quantiles of the lengths that bound the buckets; larger buckets are salted.
BUCKETS = 1024

_MOST = (1 << 63) - 1
_EXACT = 2.0**53

_VECTOR = "vec_id long, dim int, norm double, data binary"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, dim, norm, data): floor(scale * x) of every usable vector as doubles, which hold
    it exactly.  An infinite ``norm`` marks a vector whose products overflow: its data is x itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            usable = np.array(lists.is_valid()) & np.array(batch.column(0).is_valid())
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)[: off[-1]]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            usable &= bad[off[1:]] == bad[off[:-1]]
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(scale * x)
                # the vectors of one dimension are rows of a matrix
                size = np.diff(off)
                norm = np.zeros(len(size))
                for d in np.unique(size[usable]).tolist():
                    rows = np.flatnonzero(usable & (size == d))
                    m = q[off[rows][:, None] + np.arange(d)]
                    norm[rows] = np.sqrt((m * m).sum(axis=1))
            norm[~np.isfinite(norm)] = np.inf
            rows = np.flatnonzero(usable)
            data = [(x if np.isinf(norm[r]) else q)[off[r] : off[r + 1]].tobytes() for r in rows]
            ids = batch.column(0).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size[rows].astype(np.int32)), pa.array(norm[rows]), pa.array(data, pa.binary())], names=["vec_id", "dim", "norm", "data"])

    return df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, _VECTOR)


def _matrix(data: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), dim)


def _integers(row: np.ndarray, norm: float, scale: int) -> list[int]:
    if np.isfinite(norm):
        return [int(x) for x in row]
    return [int(x) * scale if np.isinf(scale * x) else int(np.floor(scale * x)) for x in row]


class _Best:
    """The k best of each query of a block."""

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.rows: list[list[tuple]] = [[] for _ in range(n)]
        self.counts = dict.fromkeys(("cells", "skipped", "by_length", "by_coordinates", "multiplied", "verified"), 0)

    def add(self, q: int, ids: np.ndarray, scores) -> None:
        own = self.rows[q]
        own.extend((-max(-_MOST, min(_MOST, int(s))), int(i)) for s, i in zip(scores, ids))
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.bound[q] = max(self.bound[q], -own[-1][0])

    def keep(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = np.flatnonzero(scores >= self.bound[j])
        if len(hit) > 4 * self.k:  # all ties with the k-th stay
            cut = np.sort(scores[hit])[-self.k]
            hit = hit[scores[hit] >= cut]
        if len(hit):
            self.add(j, ids[hit], scores[hit])


class _Chunk:
    """Vectors of one dimension, longest first, and their coordinates one after another."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, norm: np.ndarray):
        self.ids, self.v, self.norm = ids, v, norm
        self.square = norm**2
        self._columns = None
        step = max(1, len(ids) // PROBES)
        self.probe, self.probe_norm = v[::step], norm[::step]

    @property
    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        if self._columns is None:
            t = np.ascontiguousarray(self.v.T)
            self._columns = t, t * t
        return self._columns


def _chunk(rows: list[tuple], dim: int) -> _Chunk:
    return _Chunk(np.array([r[0] for r in rows]), _matrix([r[3] for r in rows], dim), np.array([r[2] for r in rows]))


_SLACK = 1 + 1e-9


def _rests(square: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, square))


def _plan(c: _Chunk, q: np.ndarray, qnorm: float, bound: float, depth: int) -> int:
    """How many coordinates to multiply first; 0: lengths take fewer multiplications."""
    dim = len(q)
    order = np.argsort(-np.abs(q), kind="stable")
    near = c.probe[c.probe_norm >= c.norm[depth - 1]]
    if not len(near):
        return 0
    own = near[:, order]
    part = np.cumsum(own * q[order], axis=1)
    rest = _rests((own**2)[:, ::-1].cumsum(axis=1)[:, ::-1] - own**2)
    rest_q = _rests(qnorm**2 - np.cumsum(q[order] ** 2))
    left = (part + rest * rest_q * _SLACK + 1 >= bound).mean(axis=0)
    cost = np.arange(1, dim + 1) + left * dim
    best = int(cost.argmin())
    return best + 1 if cost[best] < dim else 0


def _slow(c: _Chunk, j: int, q: np.ndarray, qnorm: np.ndarray, n: int, scale: int) -> np.ndarray:
    """Exact products with the chunk's first ``n`` vectors, which double precision can't hold."""
    out = np.empty(n, dtype=object)
    big = int(np.searchsorted(-c.norm[:n], -(2.0**62 / max(qnorm[j], 1e-300)), side="right")) if np.isfinite(qnorm[j]) else n
    own = _integers(q[j], qnorm[j], scale)
    for r in range(big):
        out[r] = sum(a * b for a, b in zip(own, _integers(c.v[r], c.norm[r], scale)))
    if big < n:
        out[big:] = c.v[big:n].astype(np.int64) @ q[j].astype(np.int64)
    return out


def _search(best: _Best, qid: np.ndarray, q: np.ndarray, qnorm: np.ndarray, c: _Chunk, scale: int) -> None:
    """One block of queries against one chunk of vectors."""
    n, m = len(c.ids), len(qid)
    if not n or not m:
        return
    count = best.counts
    count["cells"] += n * m
    by_length = []
    plans: dict[int, int] = {}
    for j in range(m):
        b, own = best.bound[j], qnorm[j]
        if np.isinf(own) or own * c.norm[0] >= _EXACT:
            wide = n if np.isinf(own) else int(np.searchsorted(-c.norm, -_EXACT / own, side="right"))
            got = _slow(c, j, q, qnorm, wide, scale)
            other = c.ids[:wide] != qid[j]
            best.keep(j, c.ids[:wide][other], got[other])
            count["verified"] += wide
            if wide == n:
                continue
            by_length.append((j, wide, n))
            continue
        depth = n
        if np.isfinite(b) and b > 0:
            depth = int(np.searchsorted(-c.norm, -b / max(own, 1e-300) / _SLACK, side="right")) if own > 0 else 0
        if not depth:
            count["skipped"] += n
            continue
        focus = 0
        if np.isfinite(b) and own > 0 and depth > PROBES:
            # one plan serves the queries of a block whose thresholds are alike
            cosine = round(float(b / (own * c.norm[0])) * 50)
            if cosine not in plans:
                plans[cosine] = _plan(c, q[j], own, b, depth)
            focus = plans[cosine]
        if not focus:
            by_length.append((j, 0, depth))
            continue
        cols, squares = c.columns
        order = np.argsort(-np.abs(q[j]), kind="stable")[:focus]
        part, held, tmp = np.zeros(depth), c.square[:depth].copy(), np.empty(depth)
        for k in order.tolist():
            np.multiply(cols[k, :depth], q[j, k], out=tmp)
            part += tmp
            held -= squares[k, :depth]
        np.maximum(held, 0.0, out=held)
        np.sqrt(held, out=held)
        held *= np.sqrt(max(0.0, own**2 - (q[j, order] ** 2).sum())) * _SLACK
        part += held
        reach = np.flatnonzero(part >= b - 1)
        reach = reach[c.ids[reach] != qid[j]]
        best.keep(j, c.ids[reach], c.v[reach] @ q[j])
        count["by_coordinates"] += n
        count["verified"] += len(reach)
    if by_length:
        js = np.array([j for j, _, _ in by_length])
        deepest = max(d for _, _, d in by_length)
        finite = np.where(np.isfinite(c.norm[:deepest]), 1.0, 0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            products = q[js] @ (c.v[:deepest] * finite[:, None]).T if not finite.all() else q[js] @ c.v[:deepest].T
        for r, (j, low, depth) in enumerate(by_length):
            got, ids = products[r, low:depth], c.ids[low:depth]
            other = ids != qid[j]
            best.keep(j, ids[other], got[other])
            count["by_length"] += n - low
            count["multiplied"] += depth - low


def _blocks(path: str) -> Iterator[pa.RecordBatch]:
    """The queries, a block at a time, from the shared folder."""
    for f in open_folder(path):
        yield from pq.ParquetFile(f).iter_batches(batch_size=BLOCK)


_COUNTS = ("bucket", "cells", "skipped", "by_length", "by_coordinates", "multiplied", "verified")


def _found(vectors: DataFrame, queries: DataFrame, k: int, scale: int, report: bool) -> DataFrame:
    spark = vectors.sparkSession
    # the longest vectors: a fixed number of rows, at the driver and every worker
    longest = vectors.orderBy(F.desc("norm"), "vec_id").limit(LONGEST).collect()
    first = spark.sparkContext.broadcast([(r["vec_id"], r["dim"], r["norm"], bytes(r["data"])) for r in longest])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for r in first.value:
            groups.setdefault(r[1], []).append(r)
        chunks = {d: _chunk(g, d) for d, g in groups.items() if d}
        for batch in batches:
            ids, dims, norms, data = (batch.column(c).to_pylist() for c in range(4))
            out = np.full(len(ids), -np.inf)
            for dim in set(dims) & chunks.keys():
                rows = [i for i, d in enumerate(dims) if d == dim]
                best = _Best(len(rows), k, np.full(len(rows), -np.inf))
                _search(best, np.array([ids[i] for i in rows]), _matrix([data[i] for i in rows], dim), np.array([norms[i] for i in rows]), chunks[dim], scale)
                out[rows] = best.bound
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "bound"])

    asked = table(queries.mapInArrow(bound, _VECTOR + ", bound double"), "queries")
    path = asked.lexispark_path
    total = vectors.agg(F.sum(F.octet_length("data") + 24).alias("b")).first()["b"] or 0
    need = partitions_for(spark, total)
    n_buckets = min(need, BUCKETS)
    n_salts = -(-need // n_buckets)
    cuts = vectors.agg(F.percentile_approx("norm", [j / n_buckets for j in range(1, n_buckets)], 10 * n_buckets).alias("q")).first()["q"] if n_buckets > 1 else None
    edges = np.array(sorted(set(cuts or [])), dtype=np.float64)

    @F.pandas_udf("int")
    def bucket(norm, salt):
        import pandas as pd

        x = norm.to_numpy()
        lo, hi = np.searchsorted(edges, x, side="left"), np.searchsorted(edges, x, side="right")
        # a length that ends several buckets is spread over the buckets it could be in
        spare = n_buckets - 1 - len(edges)
        s = salt.to_numpy()
        out = (hi + np.where((hi > lo) & (spare > 0), s % (spare + 1), 0)) % n_buckets
        return pd.Series((out * n_salts + s // 1024 % n_salts).astype(np.int32))

    salt = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int")
    ordered = vectors.withColumn("bucket", bucket("norm", salt)).repartitionById(n_buckets * n_salts, F.col("bucket")).sortWithinPartitions(F.col("dim"), F.desc("norm")).select("vec_id", "dim", "norm", "data", "bucket")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def run() -> Iterator[pa.RecordBatch]:
            groups: dict[int, list] = {}
            for r in held:
                groups.setdefault(r[1], []).append(r)
            at = held[0][4]
            held.clear()
            chunks = {d: [_chunk(g[x : x + CHUNK], d) for x in range(0, len(g), CHUNK)] for d, g in groups.items() if d}
            for block in _blocks(path):
                ids, dims, norms, data, bounds = (block.column(c).to_pylist() for c in range(5))
                out: list[tuple] = []
                for d, own in chunks.items():
                    rows = [i for i, x in enumerate(dims) if x == d]
                    if not rows:
                        continue
                    best = _Best(len(rows), k, np.array([bounds[i] for i in rows]))
                    qid, q, qnorm = np.array([ids[i] for i in rows]), _matrix([data[i] for i in rows], d), np.array([norms[i] for i in rows])
                    for chunk in own:
                        _search(best, qid, q, qnorm, chunk, scale)
                    if report:
                        out.append((at, *best.counts.values()))
                    else:
                        out.extend((ids[i], b, -a) for i, found in zip(rows, best.rows) for a, b in found)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=_COUNTS if report else ["query_id", "vec_id", "score"])

        for batch in batches:
            held.extend(zip(*(batch.column(c).to_pylist() for c in range(5))))
            if len(held) >= HELD:
                held.sort(key=lambda r: (r[1], -r[2]))
                yield from run()
        if held:
            held.sort(key=lambda r: (r[1], -r[2]))
            yield from run()

    return ordered.mapInArrow(search, ", ".join(f"{c} long" for c in (_COUNTS if report else ("query_id", "vec_id", "score"))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables as ``quantised`` makes them."""
    found = _found(vectors, queries, k, scale, False)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning_report(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """By bucket: pairs of query and vector (``cells``), those of queries that skip the chunk or are
    searched by lengths or by coordinates, and the products made by either way."""
    found = _found(vectors, queries, k, scale, True)
    return found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _COUNTS[1:]])
