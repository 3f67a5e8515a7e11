"""Count sketches: how often hashes occur, about and never less, in a table of bounded size.

A sketch has a count for each value of the hash's leading bits.  Tasks make
their own and pass it on compressed; added up, counts are kept in steps of an
eighth of a doubling, a byte each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import U64

#: A sketch has 2 ** 20 counts up to SKETCH_TEXT bytes of text, twice as many for twice as
#: much, and 2 ** 24 at most: a byte each where it is sent, four where it is made.
SKETCH_BITS = (20, 24)
SKETCH_TEXT = 1 << 30
PARTS = 16


def bits_for(total: int) -> int:
    """Bits of the sketch of a corpus of so many bytes."""
    low, high = SKETCH_BITS
    return min(high, low + max(0, math.ceil(math.log2(max(1, total) / SKETCH_TEXT))))


class Sketch:
    """A task's own counts."""

    def __init__(self, bits: int):
        self.bits, self.counts, self.used = bits, np.zeros(1 << bits, dtype=np.uint32), False

    def add(self, h: np.ndarray) -> None:
        np.add.at(self.counts, (h >> U64(64 - self.bits)).astype(np.int64), np.uint32(1))
        self.used = True

    def parts(self) -> tuple[pa.Array, pa.Array]:
        """Numbers and compressed counts of the sketch's parts."""
        step = len(self.counts) // PARTS
        return pa.array(range(PARTS), pa.int32()), pa.array([_small(self.counts[k * step : (k + 1) * step]) for k in range(PARTS)], pa.binary())


def _small(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes, compressed; the first byte is the width."""
    import zstandard

    top = int(x.max(initial=0))
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + zstandard.compress(x.astype(kind).tobytes(), 1)


def _large(b: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(b[1:]), dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[b[0]])


def steps(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The step of each hash: equal or larger for the more frequent."""
    return sketch[(h >> U64(65 - len(sketch).bit_length())).astype(np.int64)]


def count_of(step: np.ndarray | int):
    """The least count of a step."""
    return 2.0 ** (np.asarray(step, dtype=np.float64) / 8) - 1


def added(parts: DataFrame, bits: int) -> np.ndarray:
    """The steps of the sum of all tasks' (part, sketch); the driver gets 2 ** bits bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = _large(x).astype(np.uint64)
                held[b] = held[b] + got if b in held else got
        if held:
            low = [np.minimum(255, 8 * np.log2(v + 1.0)).astype(np.uint8) for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([_small(v) for v in low], pa.binary())], names=["part", "sketch"])

    got = parts.repartition(PARTS, "part").mapInArrow(add, "part int, sketch binary").collect()
    out = np.zeros(1 << bits, dtype=np.uint8)
    step = len(out) // PARTS
    for r in got:
        out[r["part"] * step : (r["part"] + 1) * step] = _large(bytes(r["sketch"]))
    return out
