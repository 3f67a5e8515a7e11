"""Suffix arrays by induced sorting, and permuted common prefixes, vectorised.

Suffixes are classed as smaller or larger than their successor; the leftmost
smaller ones (LMS) are sorted by their substrings, several letters at a time,
which are named, and the string of names is sorted by the same function.  The order of all suffixes is
induced from theirs in two sweeps over the buckets of first letters, each
linear in the text, which take large buckets, or batches of small ones, at a
time with array operations.
"""

from __future__ import annotations

import numpy as np

from .kernels import ranges, segments


def _classes(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last is."""
    ends = np.flatnonzero(t[:-1] != t[1:])
    small = np.repeat(t[ends] < t[ends + 1], np.diff(np.concatenate([[-1], ends])))
    return np.concatenate([small, [True]])


#: Suffixes of the buckets that a sweep takes at once, about.
BATCH = 2048


def _sweep(t: np.ndarray, wanted: np.ndarray, fixed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One sweep in ascending order of letters.

    ``fixed`` are the suffixes known before, in the sweep's order.  A suffix
    is entered in the bucket of its letter, after those entered before and
    before the fixed ones, when the one after it in the text is passed, if it
    is ``wanted``.  Returns those entered, in order, with gaps of -1 at the
    end of each bucket of ``counts`` places.

    Buckets are passed in batches.  Within a batch, what its own suffixes
    enter is found by repeating the pass until nothing is added: a chain of k
    suffixes in one batch is in place after k repeats.
    """
    n = len(t)
    ends = np.cumsum(counts)
    heads = ends - counts
    out = np.full(n, -1, dtype=np.int64)
    fill = heads.copy()
    fixed_at = np.concatenate([[0], np.cumsum(np.bincount(t[fixed], minlength=len(counts)))])

    def enter(j: np.ndarray) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order].astype(np.int64)
        at = segments(c)
        own, size = c[at[:-1]], np.diff(at)
        out[np.repeat(fill[own], size) + ranges(size)] = j[order]
        fill[own] += size

    def before(q: np.ndarray) -> np.ndarray:
        j = q - 1
        j = j[j >= 0]
        return j[wanted[j]]

    c, total = 0, len(counts)
    while c < total:
        d = max(c + 1, int(np.searchsorted(ends, heads[c] + BATCH, side="right")))
        seeds = fixed[fixed_at[c] : fixed_at[d]]
        if d == c + 1:
            q = out[heads[c] : fill[c]]
            while len(q):
                j = before(q)
                if not len(j):
                    break
                first = fill[c]
                enter(j)
                q = out[first : fill[c]]
            if len(seeds):
                j = before(seeds)
                if len(j):
                    enter(j)
        else:
            size = fill[c:d] - heads[c:d]
            known = out[np.repeat(heads[c:d], size) + ranges(size)]
            new = known[:0]
            while True:
                q = np.concatenate([known, new, seeds])
                key = t[q] - c
                q = q[np.argsort(key.astype(np.uint16) if d - c < 65536 else key, kind="stable")]
                j = before(q)
                own = t[j] < d
                last, new = len(new), j[own]
                if len(new) == last:
                    break
            if len(new):
                enter(new)
            j = j[~own]
            if len(j):
                enter(j)
        c = d
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that an order of the LMS suffixes induces."""
    top = int(t.max())
    # narrow letters are sorted by their digits
    t = t.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int32)
    counts = np.bincount(t, minlength=top + 1)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    up = _sweep(t, ~small, seeds, counts)
    # from the other side: letters and order reversed, the larger ones fixed
    down = _sweep((top - t).astype(t.dtype), small, up[up >= 0][::-1], counts[::-1])
    # in a bucket the larger suffixes come first; the end mark is the first of all
    sa = np.where(up >= 0, up, down[::-1])
    sa[0] = len(t) - 1
    return sa


def _substrings(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS substrings in order, and their names; equal ones share a name.

    Letters go with their classes, several in one number; those substrings that
    the first number leaves equal are sorted on by the next.
    """
    n = len(lms)
    letters = t.astype(np.int64) * 2 + small
    bits = max(1, int(letters.max()).bit_length())
    per = 62 // bits
    size = np.diff(np.append(lms, len(t) - 1)) + 1
    letters = np.concatenate([letters, np.zeros(per, dtype=np.int64)])

    def key(rows: np.ndarray, done: int) -> np.ndarray:
        left, at = size[rows] - done, lms[rows] + done
        out = np.zeros(len(rows), dtype=np.int64)
        for k in range(per):
            out <<= bits
            out |= np.where(k < left, letters[np.minimum(at + k, len(letters) - 1)], 0)
        return out

    first = key(np.arange(n), 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.ones(n, dtype=bool)
    np.not_equal(first[1:], first[:-1], out=new[1:])
    done = per
    while True:
        group = np.cumsum(new) - 1
        live = np.flatnonzero((np.bincount(group)[group] > 1) & (size[order] > done))
        if not len(live):
            return order, group
        more = key(order[live], done)
        by = np.lexsort((more, group[live]))
        order[live] = order[live][by]
        more, own = more[by], group[live]
        new[live[1:]] |= (more[1:] != more[:-1]) & (own[1:] == own[:-1])
        done += per


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``t``, numbers above 0 with a 0 at the end."""
    n = len(t)
    if n <= 1:
        return np.arange(n)
    small = _classes(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, names = _substrings(t, small, lms)
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), dtype=np.int64)
        reduced[order] = names
        order = suffix_array(reduced)
    return _induce(t, small, lms[order])


def permuted_lcp(t: np.ndarray, sa: np.ndarray, starts: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By text position: the suffix before in order (-1: none), and the common prefix with it.

    Where the bytes before a suffix and its predecessor are equal, the common
    prefix is one less than that at the position before; only the others are
    compared, eight bytes at a time.  With ``most``, prefixes are followed for
    about so many bytes beyond the ``starts`` of regions, where comparing begins anew.
    """
    n = len(t)
    phi = np.empty(n, dtype=np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    before = np.maximum(phi, 1) - 1
    pos = np.arange(n)
    compared = (pos == 0) | (phi <= 0) | (t[np.maximum(pos, 1) - 1] != t[before])
    if starts is not None:
        compared[starts] = True
    at = np.flatnonzero(compared)
    padded = np.concatenate([t, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    lcp = np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(phi[at] >= 0)
    while len(live):
        i, j = at[live] + lcp[live], phi[at[live]] + lcp[live]
        x = eight[i] ^ eight[j]
        low = x & (~x + np.uint64(1))
        step = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        lcp[live] += step
        live = live[step == 8]
        if most is not None:
            live = live[lcp[live] < most]
    size = np.diff(np.append(at, n))
    return phi, np.repeat(lcp, size) - ranges(size)
