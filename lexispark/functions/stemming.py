"""A Porter-style stemmer as staged column expressions.

Every rule step is a projection of its own, so a step refers to the result of
the one before by name and the plan stays linear in the number of rules.
There are no Python functions on the data's way.

``y`` is always a vowel here, the step for final ``y`` is skipped for words
that lost ``ed`` or ``ing``, and of several endings that fit, the longest
with a letter before it ends a step, whether its condition holds or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DERIVED = {
    7: "ational:ate ization:ize iveness:ive fulness:ful ousness:ous",
    6: "tional:tion biliti:ble",
    5: "entli:ent ousli:ous ation:ate alism:al aliti:al iviti:ive",
    4: "logi:log ator:ate alli:al izer:ize anci:ance enci:ence",
    3: "eli:e bli:ble",
}
_SHORTENED = "icate:ic alize:al iciti:ic ative: ical:ic ness: ful:"
_DROPPED = "ement ment ible able ence ance ize ive ous iti ate ism ent ant ou ic er al"


#: The measure of a word counts its vowel runs that a consonant run follows.
_ABOVE = {0: "[aeiouy][^aeiouy]", 1: "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"}


def _above(s: Column, least: int) -> Column:
    """Whether the measure is above 0, or above 1."""
    return s.rlike(_ABOVE[least])


def _without(w: Column, ending: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(ending))


def _ends(w: Column, ending: str) -> Column:
    """Whether the word has the ending and something before it."""
    return F.endswith(w, F.lit(ending)) & (F.length(w) > len(ending))


def _short(s: Column) -> Column:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return s.rlike(r"(?s)[^aeiouy][aeiouy][^aeiouywx]\z")


def _rule(w: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest ending that fits with a letter before it: its length, then what replaces it."""
    tries = []
    for k in sorted({len(e) for e, _ in rules}, reverse=True):
        listed = F.create_map(*[F.lit(x) for e, new in rules if len(e) == k for x in (e, f"{k}{new}")])
        tries.append(F.when(F.length(w) > k, F.element_at(listed, F.right(w, F.lit(k)))))
    return F.coalesce(*tries)


def _replaced(w: Column, rule: Column, least: int) -> Column:
    rest = F.substring(w, F.lit(1), F.length(w) - F.left(rule, F.lit(1)).cast("int"))
    return F.when(_above(rest, least), F.concat(rest, F.substring(rule, F.lit(2), F.length(rule)))).otherwise(w)


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) for p in text.split()]


def stem(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by its stems; words under three bytes stay."""
    others = [c for c in df.columns if c != column]
    w = F.col(column)

    def step(d: DataFrame, new: Column, *more: Column) -> DataFrame:
        return d.select(*others, *more, new.alias(column))

    keep = F.octet_length(F.col("_word")) < 3
    word = F.col("_word")
    d = df.select(*others, w.alias("_word"), w)

    # plurals
    es = (F.endswith(w, F.lit("sses")) & (F.length(w) > 4)) | (F.endswith(w, F.lit("ies")) & (F.length(w) > 3))
    s = F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")) & (F.length(w) > 2)
    d = step(d, F.when(es, _without(w, "es")).when(s, _without(w, "s")).otherwise(w), word)

    # ed, ing
    eed = _ends(w, "eed")
    cut = F.when(_ends(w, "ed"), _without(w, "ed")).when(_ends(w, "ing"), _without(w, "ing"))
    d = d.select(*others, word, w, F.when(~eed & cut.rlike("[aeiouy]"), cut).alias("_cut"))
    c = F.col("_cut")
    last = F.right(c, F.lit(1))
    double = c.rlike(r"(?s)([\p{IsAlphabetic}&&[^aeiouy]])\1\z") & ~last.isin("l", "s", "z")
    mended = F.when(c.rlike(r"(?:at|bl|iz)\z"), F.concat(c, F.lit("e"))).when(double, F.substring(c, F.lit(1), F.length(c) - 1)).when(_above(c, 0) & ~_above(c, 1) & _short(c), F.concat(c, F.lit("e"))).otherwise(c)
    eed_cut = F.when(_above(_without(w, "eed"), 0), F.concat(_without(w, "eed"), F.lit("e"))).otherwise(w)
    d = step(d, F.when(c.isNotNull(), mended).when(eed, eed_cut).otherwise(w), word, c.isNotNull().alias("_done"))
    y = ~F.col("_done") & w.rlike(r"(?s).[^aeiou]y\z")
    d = step(d, F.when(y, F.concat(_without(w, "y"), F.lit("i"))).otherwise(w), word)

    # derived endings
    e = F.col("_end")
    for rules, least in ((" ".join(_DERIVED.values()), 0), (_SHORTENED, 0), (" ".join(f"{x}:" for x in _DROPPED.split()), 1)):
        d = d.select(*others, word, w, _rule(w, _pairs(rules)).alias("_end"))
        new = F.when(e.isNotNull(), _replaced(w, e, least))
        if least:
            new = new.when(w.rlike(r"(?s).[st]ion\z") & _above(_without(w, "ion"), 1), _without(w, "ion"))
        d = step(d, new.otherwise(w), word)

    # final e, double l
    rest = _without(w, "e")
    d = step(d, F.when(_ends(w, "e") & (_above(rest, 1) | (_above(rest, 0) & ~_short(rest))), rest).otherwise(w), word)
    d = step(d, F.when(F.endswith(w, F.lit("ll")) & _above(w, 1), _without(w, "l")).otherwise(w), word)
    return d.select(*[F.when(keep, word).otherwise(w).alias(column) if x == column else F.col(x) for x in df.columns])
