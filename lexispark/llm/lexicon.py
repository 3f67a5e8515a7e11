"""A minimal acyclic transducer from words to token ids, memory-mapped.

The automaton of all words (byte strings) is built by incremental
minimisation over the sorted words, so equal suffixes share their states.
Every edge carries the number of words that sort before those it leads to;
their sum along a path is the word's rank, which indexes its ids.  That puts
the output outside the automaton and leaves all suffixes shareable.

The file is one block of fixed-width arrays that ``Lexicon`` maps and never
copies: all workers of a machine share its pages.
"""

from __future__ import annotations

import json

import numpy as np

_MAGIC = b"LXDAWG1\n"


def build(words: dict[bytes, list[int]]) -> bytes:
    """The file of a lexicon of non-empty words and their ids."""
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # unchecked (parent, byte, child)
    last = b""

    def minimise(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            sign = (final[child], tuple(edges[child].items()))
            same = register.get(sign)
            if same is None:
                register[sign] = child
            else:
                edges[parent][byte] = same

    ordered = sorted(w for w in words if w)
    for w in ordered:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        minimise(common)
        state = path[-1][2] if path else 0
        for b in w[common:]:
            edges.append({})
            final.append(False)
            child = len(edges) - 1
            edges[state][b] = child
            path.append((state, b, child))
            state = child
        final[state] = True
        last = w
    minimise(0)

    # number the reachable states, count the words below each
    order, number, stack = [], {0: 0}, [0]
    while stack:
        s = stack.pop()
        order.append(s)
        for t in edges[s].values():
            if t not in number:
                number[t] = len(number)
                stack.append(t)
    below: dict[int, int] = {}

    def count(root: int) -> None:
        todo = [root]
        while todo:
            s = todo[-1]
            missing = [t for t in edges[s].values() if t not in below]
            if missing:
                todo.extend(missing)
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                todo.pop()

    count(0)
    key, to, skip = [], [], []
    ends = np.zeros(len(number), dtype=np.uint8)
    for s in order:
        before = int(final[s])
        ends[number[s]] = final[s]
        for b in sorted(edges[s]):
            t = edges[s][b]
            key.append(number[s] * 256 + b)
            to.append(number[t])
            skip.append(before)
            before += below[t]
    at = np.argsort(np.array(key, dtype=np.int64), kind="stable") if key else np.empty(0, dtype=np.int64)
    ids = [words[w] for w in ordered]
    arrays = {
        "key": np.array(key, dtype=np.int64)[at],
        "to": np.array(to, dtype=np.int64)[at],
        "skip": np.array(skip, dtype=np.int64)[at],
        "final": ends,
        "ids_at": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], dtype=np.uint32),
    }
    head, blob, pos = {}, [], 0
    for name, a in arrays.items():
        head[name] = (pos, a.dtype.str, len(a))
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        blob.append(raw)
        pos += len(raw)
    said = json.dumps(head | {"longest": max(map(len, ordered), default=0)}).encode()
    said += b" " * (-(len(said) + len(_MAGIC) + 8) % 8)
    return b"".join([_MAGIC, len(said).to_bytes(8, "little"), said, *blob])


class Lexicon:
    """A mapped lexicon file; looks up many words at once."""

    def __init__(self, file: str):
        raw = np.memmap(file, dtype=np.uint8, mode="r")
        if raw[: len(_MAGIC)].tobytes() != _MAGIC:
            raise ValueError(f"not a lexicon: {file}")
        n = int.from_bytes(raw[8:16].tobytes(), "little")
        head = json.loads(raw[16 : 16 + n].tobytes())
        self.longest = head.pop("longest")
        for name, (pos, kind, size) in head.items():
            at = 16 + n + pos
            setattr(self, name, raw[at : at + size * np.dtype(kind).itemsize].view(kind))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of every word; -1 for those that aren't in the lexicon."""
        out = np.full(len(words), -1, dtype=np.int64)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        live = np.flatnonzero((lens > 0) & (lens <= self.longest))
        if not len(live) or not len(self.key):
            return out
        buf = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = (np.cumsum(lens) - lens)[live]
        left = lens[live]
        state = np.zeros(len(live), dtype=np.int64)
        rank = np.zeros(len(live), dtype=np.int64)
        while len(live):
            want = state * 256 + buf[at]
            e = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[e] == want
            live, at, left, e = live[hit], at[hit] + 1, left[hit] - 1, e[hit]
            state, rank = self.to[e], rank[hit] + self.skip[e]
            done = left == 0
            whole = done & (self.final[state] == 1)
            out[live[whole]] = rank[whole]
            live, at, left, state, rank = (x[~done] for x in (live, at, left, state, rank))
        return out

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.ids_at[rank] : self.ids_at[rank + 1]]
