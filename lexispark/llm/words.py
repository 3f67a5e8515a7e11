"""Exact encodings of whole texts through a bounded table of words.

A tokenizer whose pre-tokenizer never lets a token cross ASCII white space
encodes a text as the concatenation of its words' encodings.  ``WordTable``
keeps words' encodings in a bounded dictionary of each worker; the library
itself encodes every word that isn't in it.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that a worker's table holds at most; further words are encoded each time.
WORDS_KEPT = 500_000

_loaded: dict[tuple, object] = {}

_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)\\Z")


def release() -> None:
    """Gives back the memory of all tables: a worker may go on with another operator."""
    held = [k for k in _loaded if k[0] != "file"]
    for k in held:
        del _loaded[k]
    if held:
        import ctypes
        import gc

        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps it, which is no error
            return


def load(path: str):
    """A tokenizer file, once per worker: ``.json`` or sentencepiece's ``.model``."""
    got = _loaded.get(("file", path))
    if got is None:
        if path.endswith(".model"):
            import sentencepiece

            got = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            got = Tokenizer.from_file(path)
            got.no_truncation()
            got.no_padding()
        _loaded["file", path] = got
    return got


def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    tok = load(path)
    return max(tok.get_vocab(with_added_tokens=True).values()) + 1 if path.endswith(".json") else tok.get_piece_size()


def _settings(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _normalizers(path: str) -> list[dict]:
    norm = _settings(path).get("normalizer")
    return norm.get("normalizers", [norm]) if norm else []


def splits_at_space(path: str) -> bool:
    """Whether the file's own settings prove that words are encoded independently.

    True for a normaliser made of NFC, white-space folding and lower-casing
    (none of which looks across a white-space character) with a splitting
    pattern that drops white space, and special strings without white space
    or stripping flags.
    """
    if not path.endswith(".json"):
        return False
    j = _settings(path)
    if any(p["type"] not in ("NFC", "Lowercase") and not (p["type"] == "Replace" and p["pattern"] == {"Regex": "\\s+"} and p["content"] == " ") for p in _normalizers(path)):
        return False
    pre = j.get("pre_tokenizer") or {}
    split = (pre.get("pretokenizers") or [pre])[0]
    if split.get("type") != "Split" or not split.get("invert") or split.get("behavior") != "Removed":
        return False
    if re.search(r"\\s(?!\\p)|\\S| ", split["pattern"].get("Regex", " ").replace("[^\\s\\p{L}\\p{N}]", "")):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in j["added_tokens"])


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(extra)) for b in range(256)]


BYTE_CHARS = _byte_chars()
_AS_CHARS = {b: c for b, c in enumerate(BYTE_CHARS)}


def pre_token_ids(tokenizer, text: str) -> list[int]:
    """Ids of one pre-token: the model's merges alone, without the library's other stages."""
    if not text.isascii() or " " in text:
        text = text.encode("utf-8").decode("latin-1").translate(_AS_CHARS)
    return [t.id for t in tokenizer.model.tokenize(text)]


class WordTable(dict):
    """word (UTF-8 bytes without ASCII white space) -> ``make(ids)``, filled on demand."""

    def __init__(self, path: str, make, join):
        self.tokenizer, self.make, self.join = load(path), make, join
        self.stems: dict[str, object] = {}
        self.tails: dict[str, object] = {"": make([])}
        self.lower = str.lower if "Lowercase" in [p["type"] for p in _normalizers(path)] else str

    def __missing__(self, word: bytes):
        text = word.decode("utf-8")
        m = _LETTERS.match(text)
        if m:  # letters, then marks: two pre-tokens whatever they are
            stem, tail = self.lower(m[1]), m[2]
            first = self.stems.get(stem)
            if first is None:
                first = self.make(pre_token_ids(self.tokenizer, stem))
                if len(self.stems) < WORDS_KEPT:
                    self.stems[stem] = first
            last = self.tails.get(tail)
            if last is None:
                last = self.make(self.tokenizer.encode(tail, add_special_tokens=False).ids)
                if len(self.tails) < 1000:
                    self.tails[tail] = last
            got = self.join(first, last)
        else:
            got = self.make(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) < WORDS_KEPT:
            self[word] = got
        return got


def word_table(path: str, kind: str) -> WordTable:
    """The worker's table; kind ``ids`` (little-endian uint32 bytes) or ``count``."""
    got = _loaded.get((kind, path))
    if got is None:
        if kind == "ids":
            import struct

            got = WordTable(path, lambda ids: struct.pack(f"<{len(ids)}I", *ids), lambda a, b: a + b)
        else:
            got = WordTable(path, len, lambda a, b: a + b)
        _loaded[kind, path] = got
    return got
