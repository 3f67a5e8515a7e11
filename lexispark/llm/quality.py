"""Quality rules: base counts and divergence from language references.

Two passes over whole texts.  The first makes a reference of every language
from *all* its documents: a histogram of character classes, and one of its common
words, which are the words that make up at least ``COMMON_SHARE`` of the
language's words (so at most 1 / COMMON_SHARE of them, whatever the corpus).
Word counts are exchanged once, packed by hash range.  The second pass holds
the references and compares each document's two histograms with those of its
language by Jensen-Shannon distance, the square root of the divergence in
bits.  Documents of every length are judged.  The threshold of words widens for
short ones by what chance does to their distance; that of classes needn't, as
chance stays below it for the shortest text that passes the base rules.

Every language with a word has a reference of its own, whatever its size, up to
the ``LANGUAGES`` largest, which bounds what is sent to the workers.  No words
are compared with a mixture of languages: a document without a language (null
or empty) is compared with every reference and judged by the one that it fits
best; one of a language beyond the largest, and all where no row has a
language, are judged by character classes only (word_distance 0), against those of
all documents, with the letters of all scripts as one class.

Nulls are texts without words; they and texts of blanks fail the base rules.
Repeated rows are judged each, very long texts whole.  Other columns are ignored
(``quality_filter`` passes them on), whatever their names.  An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import drop_table, partitions_for, table
from .kernels import LOWER, U64, chained, mix, ranges, row_of, segments, slices, word_hashes, word_spans

COMMON_SHARE = 1 / 1000
LANGUAGES = 256
#: Distances beyond which a document is rejected: of character classes; and of words,
#: above the distance that so many words drawn from the reference would have.
CLASS_DISTANCE = 0.30
WORD_EXCESS = 0.13
#: Standard deviations of the divergence that chance is granted beyond its mean, besides the excess.
DEVIATIONS = 1

_ALL = "\0all"  # the character classes of all documents; no language has this name

#: Classes of characters, each told by its first byte: small letters, capitals, digits,
#: blanks, sentence marks, markup symbols, other ASCII, and all beyond ASCII.
CLASSES = np.full(256, 7, dtype=np.int64)
CLASSES[:128] = 6
CLASSES[97:123] = 0
CLASSES[65:91] = 1
CLASSES[48:58] = 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[[ord(c) for c in ".,;:'\"-()?"]] = 4
CLASSES[[ord(c) for c in "#*$%&|<>!"]] = 5
CLASSES[128:192] = 8  # continuation bytes aren't counted
N_CLASSES = 8
_SUMS = [f"c{k}" for k in range(N_CLASSES)]

#: Where small letters and the letters beyond ASCII are counted together.
_MERGED = np.array([0, 1, 2, 3, 4, 5, 6, 0])

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_NEWLINE = 10


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each row has."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _class_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    row = np.repeat(np.arange(n) * (N_CLASSES + 1), np.diff(off))
    got = np.bincount(row + CLASSES[buf], minlength=n * (N_CLASSES + 1))
    return got.reshape(n, N_CLASSES + 1)[:, :N_CLASSES]


def _repeat_words(hashes: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """Words of each row in windows of ``width`` words that the row holds twice or more."""
    n_rows, n = len(first) - 1, len(hashes)
    out = np.zeros(n_rows, dtype=np.int64)
    if n < width:
        return out
    h = chained(hashes, width)
    row = row_of(first)
    starts = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    if not len(starts):
        return out
    key = mix(h[starts] + row[starts].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return out
    # windows with equal keys are compared word by word
    a, b = starts[order[:-1][same]], starts[order[1:][same]]
    true = row[a] == row[b]
    for k in range(width):
        true &= hashes[a + k] == hashes[b + k]
    cover = np.zeros(n + 1, dtype=np.int64)
    twice = np.unique(np.concatenate([a[true], b[true]]))
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    return _per_row(np.cumsum(cover)[:-1] > 0, first)


def _dup_lines(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines of each row with a word, equal to an earlier line of it; the lines themselves are compared."""
    out = np.zeros(len(off) - 1, dtype=np.int64)
    breaks = _per_row(buf == _NEWLINE, off)
    raw = buf.tobytes()
    for r in np.flatnonzero(breaks).tolist():
        lines = [x for x in raw[off[r] : off[r + 1]].split(b"\n") if x.strip()]
        out[r] = len(lines) - len(set(lines))
    return out


def base_counts(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base columns of each row; word hashes (of ASCII lower case) and first words."""
    starts, ends, first = word_spans(buf, off)
    inside = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=inside[1:])
    chars = np.concatenate([[0], np.cumsum(inside[ends] - inside[starts])])
    n_words = np.diff(first)
    out = {
        "n_words": n_words,
        "word_chars": chars[first[1:]] - chars[first[:-1]],
        "n_symbols": _per_row(SYMBOLS[buf], off),
        "n_dup_lines": _dup_lines(buf, off),
        "n_repeat_words": _repeat_words(word_hashes(buf, off), first),
    }
    out["base_failed"] = (n_words < 20) | (100 * out["n_repeat_words"] > 30 * n_words)
    return out, word_hashes(LOWER[buf], off), first


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """The references of all languages: {language: (classes, word hashes, word shares)}; of all documents, the classes."""
    spark = df.sparkSession
    # tasks pass on 16 bytes for each of their distinct words, less than the text itself
    blocks = partitions_for(spark, df.agg(F.sum(F.octet_length(text))).first()[0] or 0)

    none = [0] * N_CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for name, (classes, total, hashes, counts) in held.items():
                rows.append((name, -1, total, b"", b"", *classes.tolist()))
                h, n = _added(hashes, counts)
                block = (h % U64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                h, n, at = h[order], n[order], np.searchsorted(block[order], np.arange(blocks + 1))
                rows += [(name, b, 0, h[at[b] : at[b + 1]].tobytes(), n[at[b] : at[b + 1]].tobytes(), *none) for b in range(blocks) if at[b] < at[b + 1]]
            held.clear()
            types = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * N_CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lang", "block", "total", "keys", "counts", *_SUMS])

        for batch in batches:
            for part, buf, off in slices(batch):
                names = ["" if x is None else x for x in part.column(0).to_pylist()]
                _, _, first = word_spans(buf, off)
                h = word_hashes(LOWER[buf], off)
                classes = _class_counts(buf, off)
                code = {x: k for k, x in enumerate(dict.fromkeys(names))}
                of = np.array([code[x] for x in names])
                word_of = of[row_of(first)]
                for x, k in code.items():
                    mine = h[word_of == k]
                    u, n = np.unique(mine, return_counts=True)
                    got = held.setdefault(x, [np.zeros(N_CLASSES, dtype=np.int64), 0, [], []])
                    got[0] = got[0] + classes[of == k].sum(axis=0)
                    got[1] += len(mine)
                    got[2].append(u)
                    got[3].append(n)
                    size += len(u)
                    if len(got[2]) >= 32:
                        before = sum(map(len, got[2]))
                        u, n = _added(got[2], got[3])
                        got[2], got[3] = [u], [n]
                        size += len(u) - before
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    counted = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, block int, total long, keys binary, counts binary, " + ", ".join(f"{c} long" for c in _SUMS))
    packed = table(counted, "word-counts")
    sums = [F.sum(c).alias(c) for c in _SUMS]
    heads = packed.where("block = -1").groupBy("lang").agg(F.sum("total").alias("total"), *sums)
    named = {r["lang"]: (r["total"], np.array([r[c] for c in _SUMS], dtype=np.int64)) for r in heads.where((F.col("total") > 0) & (F.col("lang") != "")).orderBy(F.desc("total"), "lang").limit(LANGUAGES).collect()}
    all_classes = np.array([x or 0 for x in heads.agg(*sums).first()], dtype=np.int64)
    totals = {x: n for x, (n, _) in named.items()}

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for x, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if x not in totals:
                    continue
                k, c = parts.setdefault(x, ([], []))
                k.append(np.frombuffer(keys, dtype=U64))
                c.append(np.frombuffer(counts, dtype=np.int64))
                if len(k) >= 64:
                    u, n = _added(k, c)
                    parts[x] = ([u], [n])
        for name, (k, c) in parts.items():
            u, n = _added(k, c)
            keep = n >= COMMON_SHARE * totals[name]
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(keep.sum()), pa.string()), pa.array(u[keep].view(np.int64)), pa.array(n[keep])], names=["lang", "word", "n"])

    found = packed.where("block >= 0").select("block", "lang", "keys", "counts").repartition(blocks, "block").select("lang", "keys", "counts").mapInArrow(common, "lang string, word long, n long").collect()
    drop_table(packed)
    out = {_ALL: (all_classes / max(1, all_classes.sum()), np.empty(0, dtype=U64), np.empty(0))}
    for name, total in totals.items():
        own = sorted((r["word"], r["n"]) for r in found if r["lang"] == name)
        h = np.array([w for w, _ in own], dtype=np.int64).view(U64)
        order = np.argsort(h)
        classes = named[name][1]
        share = np.array([n for _, n in own], dtype=np.float64)[order] / max(1, total)
        out[name] = (classes / max(1, classes.sum()), h[order], share)
    return out


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys) if keys else np.empty(0, dtype=U64)
    c = np.concatenate(counts) if counts else np.empty(0, dtype=np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = segments(k)
    return (k[at[:-1]], np.add.reduceat(c, at[:-1])) if len(k) else (k, c)


def _xlog(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(p / m), 0.0)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``."""
    m = (p + q) / 2
    return np.sqrt(np.maximum(0, (_xlog(p, m) + _xlog(np.broadcast_to(q, p.shape), m)).sum(axis=-1) / 2))


def _word_distance(h: np.ndarray, first: np.ndarray, hashes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Distance of each row's histogram over the common words, and one bin for the rest."""
    n_rows = len(first) - 1
    total = np.diff(first)
    if not len(hashes):
        return np.zeros(n_rows)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[at] == h
    row = row_of(first)
    k = len(hashes)
    cell, n = np.unique(row[hit] * k + at[hit], return_counts=True)
    r, w = cell // k, cell % k
    p = n / total[r]
    q = share[w]
    m = (p + q) / 2
    terms = _xlog(p, m) + _xlog(q, m)
    div = np.bincount(r, terms, n_rows).astype(np.float64)  # no terms: integers
    # a common word that the row lacks adds its whole share
    div += share.sum() - np.bincount(r, q, n_rows)
    rest_p = 1 - np.bincount(r, p, n_rows)
    rest_q = np.full(n_rows, max(0.0, 1 - share.sum()))
    m = (rest_p + rest_q) / 2
    div += _xlog(np.maximum(rest_p, 0), m) + _xlog(rest_q, m)
    return np.where(total > 0, np.sqrt(np.maximum(0, div / 2)), 1.0)


def _chance_distance(n_words: np.ndarray, share: np.ndarray) -> np.ndarray:
    """About the distance from the reference that so many words drawn from it stay below.

    A bin of share q adds 1 / (8 n ln 2) bits to the expected divergence, and
    twice the square of that to its variance; one too rare to be drawn often
    adds no more than the q / 2 of its absence, and by being drawn, which adds
    about 1 / (2 n), q / (4 n) to the variance.
    """
    q = np.sort(np.append(share, max(0.0, 1 - share.sum())))
    upto = np.concatenate([[0], np.cumsum(q)])
    n = np.maximum(1, n_words)
    each = 1 / (8 * math.log(2) * n)
    rare = np.searchsorted(q, 2 * each)
    often = len(q) - rare
    deviation = np.sqrt(upto[rare] / (4 * n) + 2 * often * each**2)
    return np.sqrt(upto[rare] / 2 + often * each + DEVIATIONS * deviation)


class _Every:
    """All languages' references in one look-up: for each common word, who has it and with what share."""

    def __init__(self, refs: dict):
        self.refs = [r for x, r in refs.items() if x != _ALL]
        lens = [len(h) for _, h, _ in self.refs]
        h = np.concatenate([h for _, h, _ in self.refs]) if lens else np.empty(0, dtype=U64)
        order = np.argsort(h, kind="stable")
        self.ref = np.repeat(np.arange(len(lens)), lens)[order]
        self.share = np.concatenate([q for _, _, q in self.refs])[order] if lens else np.empty(0)
        self.at = segments(h[order])
        self.hashes = h[order][self.at[:-1]]

    def word_distances(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``_word_distance`` of each row to each reference: (rows, references)."""
        shape = n_rows, n_refs = len(first) - 1, len(self.refs)
        total = np.diff(first)
        if not len(self.hashes):
            return np.zeros(shape)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        k = len(self.hashes)
        cell, n = np.unique(row_of(first)[hit] * k + at[hit], return_counts=True)
        r, w = cell // k, cell % k
        has = self.at[w + 1] - self.at[w]
        entry = np.repeat(self.at[w], has) + ranges(has)
        p = np.repeat(n / total[r], has)
        q = self.share[entry]
        m = (p + q) / 2
        to = np.repeat(r, has) * n_refs + self.ref[entry]

        def add(x: np.ndarray) -> np.ndarray:
            return np.bincount(to, x, n_rows * n_refs).astype(np.float64).reshape(shape)

        shares = np.bincount(self.ref, self.share, n_refs)
        div = add(_xlog(p, m) + _xlog(q, m)) + shares - add(q)
        rest_p = np.maximum(0, 1 - add(p))
        rest_q = np.broadcast_to(np.maximum(0, 1 - shares), shape)
        m = (rest_p + rest_q) / 2
        div += _xlog(rest_p, m) + _xlog(rest_q, m)
        return np.where(total[:, None] > 0, np.sqrt(np.maximum(0, div / 2)), 1.0)

    def best(self, shares: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class distance, word distance and chance distance of each row to the reference that it fits best."""
        counts = np.diff(first)
        word_d = self.word_distances(h, first)
        class_d = np.stack([js_distance(shares, c) for c, _, _ in self.refs], axis=1)
        chance = np.stack([_chance_distance(counts, q) for _, _, q in self.refs], axis=1)
        # within both thresholds of some reference, if of any, of this one
        at = np.maximum(class_d / CLASS_DISTANCE, (word_d - chance) / WORD_EXCESS).argmin(axis=1)
        k = np.arange(len(at))
        return class_d[k, at], word_d[k, at], chance[k, at]


def _merged(classes: np.ndarray) -> np.ndarray:
    """Histograms with the letters of all scripts as one class."""
    out = np.zeros((len(classes), N_CLASSES - 1))
    np.add.at(out.T, _MERGED, classes.T)
    return out


def _judge(buf: np.ndarray, off: np.ndarray, names: list, refs: dict, every: _Every) -> dict[str, np.ndarray]:
    out, h, first = base_counts(buf, off)
    n_words = out["n_words"]
    classes = _class_counts(buf, off)
    shares = classes / np.maximum(1, classes.sum(axis=1))[:, None]
    # "": to be compared with every reference
    known = [x if x in refs else _ALL if x or not every.refs else "" for x in names]
    code = {x: k for k, x in enumerate(dict.fromkeys(known))}
    of = np.array([code[x] for x in known])
    class_d, word_d, chance = np.zeros(len(of)), np.zeros(len(of)), np.zeros(len(of))
    for x, k in code.items():
        rows = np.flatnonzero(of == k)
        if x == _ALL:
            class_d[rows] = js_distance(_merged(shares[rows]), _merged(refs[x][0][None])[0])
            continue
        counts = n_words[rows]
        mine = np.repeat(first[rows], counts) + ranges(counts)
        own, upto = h[mine], np.concatenate([[0], np.cumsum(counts)])
        if not x:
            class_d[rows], word_d[rows], chance[rows] = every.best(shares[rows], own, upto)
            continue
        ref_classes, hashes, share = refs[x]
        class_d[rows] = js_distance(shares[rows], ref_classes)
        word_d[rows] = _word_distance(own, upto, hashes, share)
        chance[rows] = _chance_distance(counts, share)
    out["class_distance"], out["word_distance"] = class_d, word_d
    strange = (class_d > CLASS_DISTANCE) | (word_d > chance + WORD_EXCESS)
    out["kept"] = ~out["base_failed"] & ~strange
    return out


_COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("class_distance", T.DoubleType()), ("word_distance", T.DoubleType())]


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", refs: dict | None = None) -> DataFrame:
    """(key, base columns, base_failed, kept, class_distance, word_distance) of every row."""
    refs = references(df, text, lang) if refs is None else refs
    shared = df.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        every = _Every(shared.value)
        for batch in batches:
            for part, buf, off in slices(batch):
                got = _judge(buf, off, part.column(1).to_pylist(), shared.value, every)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(got[c]) for c, _ in _COLUMNS]], names=[key, *[c for c, _ in _COLUMNS]])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(c, t) for c, t in _COLUMNS]])
    return df.select(F.col(key), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(run, schema)


def quality_filter(df: DataFrame, text: str = "text", lang: str = "lang", refs: dict | None = None) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns and no shuffle."""
    refs = references(df, text, lang) if refs is None else refs
    shared = df.sparkSession.sparkContext.broadcast(refs)
    at = df.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.release()
        every = _Every(shared.value)
        for batch in batches:
            for part, buf, off in slices(batch, text):
                got = _judge(buf, off, part.column(at).cast(pa.string()).to_pylist(), shared.value, every)
                yield part.filter(pa.array(got["kept"]))

    return df.mapInArrow(run, df.schema)
