"""Words to terms in Python: what ``Language`` says as column expressions, for the index build.

A worker keeps the words it has seen, so each is trimmed and stemmed about once a
worker.  Which characters are letters is the JVM's word, not Python's: ``alphabet``
asks it once.  Languages that aren't built of ``Language`` itself may redefine any of
it; ``plain`` tells them apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

from .languages import _BLANKS, _CJK, _WORD, Language, MultiLanguage
from .stemming import _ABOVE, _DERIVED, _DROPPED, _SHORTENED, _pairs

#: Words that a worker keeps.
KEPT = 500_000

_SCRIPT = r"(?:\\x\{[0-9A-Fa-f]+\}|-|[^\\\[\]&^-])*"
_found: list[tuple[str, str]] = []


def plain(language: Language) -> bool:
    """Whether the language is made of ``Language`` alone, with scripts that are ranges of characters."""
    own = type(language) is Language or type(language) is MultiLanguage
    return own and all(type(x) is Language and re.fullmatch(_SCRIPT, x.script) for x in language.parts)


def _class(chars: str) -> str:
    """A regular expression's class of these rising characters, as ranges."""
    out, codes = [], list(map(ord, chars))
    for k, c in enumerate(codes):
        if k and c == codes[k - 1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


def alphabet(spark: SparkSession) -> tuple[str, str]:
    """Classes of the characters that words are trimmed of, and of those that aren't alphabetic."""
    if not _found:
        every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))))
        pattern = spark.sparkContext._jvm.java.util.regex.Pattern
        marks, others = (pattern.compile(p).matcher(every).replaceAll("") for p in (f"[{_WORD}]+", r"\p{IsAlphabetic}+"))
        _found.append((_class("\0" + marks), _class("\0" + others)))
    return _found[0]


def _python(java: str) -> str:
    """A class of characters in Python's syntax."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", java)


_above0, _above1 = (re.compile(_ABOVE[n]).search for n in (0, 1))
_vowel = re.compile("[aeiouy]").search
_short = re.compile(r"[^aeiouy][aeiouy][^aeiouywx]\Z").search
_y = re.compile(r"(?s).[^aeiou]y\Z").search
_ion = re.compile(r"(?s).[st]ion\Z").search


def _rules(text: str) -> dict[str, list[tuple[str, int, str]]]:
    """(ending, its length, what replaces it) by the ending's last two characters, longest first."""
    by: dict[str, list] = {}
    for end, new in sorted(_pairs(text), key=lambda p: -len(p[0])):
        by.setdefault(end[-2:], []).append((end, len(end), new))
    return by


_STEPS = [(_rules(t), above) for t, above in ((" ".join(_DERIVED.values()), _above0), (_SHORTENED, _above0), (" ".join(f"{x}:" for x in _DROPPED.split()), _above1))]
#: How words end that any step changes.
_LAST = frozenset({end[-1] for rules, _ in _STEPS for end in rules} | set("sdgyenl"))


class Stemmer:
    """``stemming.stem`` of one word."""

    def __init__(self, others: str):
        self.alphabetic = re.compile(f"[^{others}]").match

    def __call__(self, word: str) -> str:
        if word[-1] not in _LAST or len(word.encode()) < 3:
            return word
        w = word
        if w.endswith("sses") and len(w) > 4 or w.endswith("ies") and len(w) > 3:
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss") and len(w) > 2:
            w = w[:-1]
        eed = w.endswith("eed") and len(w) > 3
        c = None
        if not eed:
            c = w[:-2] if w.endswith("ed") and len(w) > 2 else w[:-3] if w.endswith("ing") and len(w) > 3 else None
        if c is not None and _vowel(c):
            if c.endswith(("at", "bl", "iz")):
                w = c + "e"
            elif len(c) > 1 and c[-1] == c[-2] and c[-1] not in "aeiouylsz" and self.alphabetic(c[-1]):
                w = c[:-1]
            else:
                w = c + "e" if _above0(c) and not _above1(c) and _short(c) else c
        else:
            if eed and _above0(w[:-3]):
                w = w[:-3] + "e"
            if _y(w):
                w = w[:-1] + "i"
        for rules, above in _STEPS:
            for end, k, new in rules.get(w[-2:], ()):
                if w.endswith(end) and len(w) > k:
                    if above(w[:-k]):
                        w = w[:-k] + new
                    break
            else:
                if above is _above1 and _ion(w) and _above1(w[:-3]):
                    w = w[:-3]
        if w.endswith("e") and len(w) > 1:
            rest = w[:-1]
            if _above1(rest) or _above0(rest) and not _short(rest):
                w = rest
        return w[:-1] if w.endswith("ll") and _above1(w) else w


class _Marks(dict):
    """Whether a character is one that words are trimmed of."""

    def __init__(self, marks: str):
        self.match = re.compile(f"[{marks}]").match

    def __missing__(self, c: str) -> bool:
        self[c] = found = self.match(c) is not None
        return found


class Words(dict):
    """Numbers of the terms that raw words become; -1 for those that the index leaves out."""

    def __init__(self, language: Language, marks: str, others: str):
        first = language.parts[0]
        self.kept = re.compile(f"[{_python(_CJK)}]").match if first.script else None
        self.marks = _Marks(marks)
        self.stops, self.stemmers = language.stop_words, [Stemmer(others) for x in language.parts if x.stems]
        self.numbers: dict[str, int] = {}
        self.terms: list[str] = []

    def __missing__(self, raw: str) -> int:
        term = raw if raw.isascii() and raw.isalnum() or self.kept and self.kept(raw) else self.edges(raw)
        n = -1
        if term and term not in self.stops:
            for stem in self.stemmers:
                term = stem(term)
            n = self.numbers.setdefault(term, len(self.terms))
            if n == len(self.terms):
                self.terms.append(term)
        self[raw] = n
        return n

    def edges(self, raw: str) -> str:
        """Without marks at its edges."""
        marks, a, b = self.marks, 0, len(raw)
        while a < b and marks[raw[a]]:
            a += 1
        while a < b and marks[raw[b - 1]]:
            b -= 1
        return raw[a:b]

    def trim(self) -> None:
        """Empties it if it holds more than a worker keeps."""
        if len(self) > KEPT:
            self.clear()
            self.numbers.clear()
            self.terms.clear()


#: Separators besides the blank.
OTHER_BLANKS = "\t\n\r\f\v\xa0-"


def split(lowered: str) -> list[str]:
    """What separators part, empty pieces as well; each separator is one character."""
    for b in OTHER_BLANKS:
        if b in lowered:
            lowered = lowered.replace(b, " ")
    return lowered.split(" ")


class Tokens:
    """(raws, starts, lengths) of a lower-cased text of a language with scripts, or of several at once."""

    def __init__(self, language: Language):
        self.once = len(language.parts) > 1
        self.parts = []
        for x in language.parts:
            script = _python(x.script)
            self.parts.append((re.compile(rf"([{script}]+)|[^{script}{_python(_BLANKS)}-]+").finditer if script else None))

    def __call__(self, lowered: str) -> tuple[list[str], list[int], list[int]]:
        found = list(self.each(lowered))
        if self.once:  # each raw word once a text, where it comes first
            firsts: dict[str, tuple] = {}
            for x in found:
                firsts.setdefault(x[0], x)
            found = list(firsts.values())
        return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]

    def each(self, lowered: str) -> Iterator[tuple[str, int, int]]:
        for units in self.parts:
            if units is None:
                at = 0
                for raw in split(lowered):
                    if raw:
                        yield raw, at, len(raw)
                    at += len(raw) + 1
                continue
            for m in units(lowered):
                unit, at = m[0], m.start()
                if m[1] is None:
                    yield unit, at, len(unit)
                    continue
                for size in (1, 2):
                    for k in range(len(unit) - size + 1):
                        yield unit[k : k + size], at + k, size
