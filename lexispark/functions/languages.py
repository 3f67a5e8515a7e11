"""Languages: how texts become terms, as column expressions.

A text is lower-cased and cut into *units* that cover it without gaps: runs
of the language's script, runs of other characters, and separators.  A unit's
start is the length of all units before it; script runs give each of their
characters and each pair of neighbours, other runs are one token each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemming import stem

HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}"
HIRAGANA = r"\x{3040}-\x{309F}"
KATAKANA = r"\x{30A0}-\x{30FF}\x{FF65}-\x{FF9F}"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}"
_CJK = HAN + HIRAGANA + KATAKANA + HANGUL

_BLANKS = r" \t\n\r\f\x0B\x{A0}"
_WORD = r"\p{IsAlphabetic}\p{N}_"
_EDGES = rf"^[^{_WORD}]+|[^{_WORD}]+\z"

#: By length: the words that the English index leaves out.
_STOP = {
    1: "i a",
    2: "us to so or on of no my me is it in if he do by be at as an am we",
    3: "you yet why who was too the she say our own off nor not may let its his how her has had got get for did can but any are all and him",
    4: "your with will when what were twas tis this they then them than that some said says only most must like whom just into hers have from ever else does dear been also able",
    5: "would which while where wants there these their since other often might least every could among about after",
    6: "should rather likely either cannot across almost",
    7: "neither however because",
}
STOP_WORDS = frozenset(w for x in _STOP.values() for w in x.split())

ENGLISH_SEPARATORS = " \t\n\r\x0c\x0b -"
PLAIN_SEPARATORS = " \t\n\r\x0c\x0b "


@dataclass(frozen=True)
class Language:
    """One language; subclass it, or give another script, to add one."""

    code: str
    script: str = ""
    stems: bool = False
    stop_words: frozenset = frozenset()
    query_separators: str = PLAIN_SEPARATORS
    labels: tuple[str, ...] = ()

    @property
    def parts(self) -> tuple["Language", ...]:
        return (self,)

    def units(self, lowered: Column) -> Column:
        """Array of units that cover a text of a language with a script."""
        pattern = rf"[{self.script}]+|[^{self.script}{_BLANKS}-]+|[{_BLANKS}-]"
        return F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))

    def tokens_of(self, unit: Column) -> Column:
        """Array of (term, at, length) of a unit; a separator has none."""
        none = F.array().cast("array<struct<term:string,at:int,length:int>>")
        whole = F.array(F.struct(unit.alias("term"), F.lit(0).alias("at"), F.length(unit).alias("length")))
        n = F.length(unit)

        def grams(size: int) -> Column:
            at = F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda k: F.struct(F.substring(unit, k + 1, F.lit(size)).alias("term"), k.alias("at"), F.lit(size).alias("length")))

        return F.when(unit.rlike(rf"^[{_BLANKS}-]\z"), none).when(unit.rlike(rf"^[{self.script}]"), F.concat(grams(1), grams(2))).otherwise(whole)

    def trim(self, term: Column) -> Column:
        """Without marks at its edges; empty if nothing is left."""
        trimmed = F.regexp_replace(term, _EDGES, "")
        return F.when(term.rlike(rf"^[{_CJK}]"), term).otherwise(trimmed) if self.script else trimmed

    def is_stop_word(self, term: Column) -> Column:
        return term.isin(sorted(self.stop_words)) if self.stop_words else F.lit(False)

    def stemmed(self, df: DataFrame, column: str) -> DataFrame:
        return stem(df, column) if self.stems else df


@dataclass(frozen=True)
class MultiLanguage(Language):
    """Several languages at once: their tokens in turn, each raw term once a
    text; the first one's trimming; any one's stop words; all stemmers."""

    languages: tuple[Language, ...] = ()

    @property
    def parts(self) -> tuple[Language, ...]:
        return self.languages

    def trim(self, term: Column) -> Column:
        return self.languages[0].trim(term)

    def stemmed(self, df: DataFrame, column: str) -> DataFrame:
        for x in self.languages:
            df = x.stemmed(df, column)
        return df


def multi(*languages: Language) -> MultiLanguage:
    return MultiLanguage("-".join(x.code for x in languages), languages=tuple(languages), stop_words=frozenset().union(*(x.stop_words for x in languages)))


ENGLISH = Language("en", stems=True, stop_words=STOP_WORDS, query_separators=ENGLISH_SEPARATORS, labels=("trimmer", "stopWordFilter", "stemmer"))
CHINESE = Language("zh", HAN)
JAPANESE = Language("ja", HAN + HIRAGANA + KATAKANA)
KOREAN = Language("ko", HANGUL + HAN)

LANGUAGES = {x.code: x for x in (ENGLISH, CHINESE, JAPANESE, KOREAN)}


def language_from_code(code: str) -> Language:
    """A language, or several joined by ``-``."""
    parts = code.split("-")
    for p in parts:
        if p not in LANGUAGES:
            raise ValueError(f"unsupported language code: {code}")
    return LANGUAGES[code] if len(parts) == 1 else multi(*(LANGUAGES[p] for p in parts))


def raw_words(df: DataFrame, language: Language, text: str) -> DataFrame:
    """(raw) of every token, without starts; of several languages, as each has them."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = None
    for part in language.parts:
        if part.script:
            units = df.select(F.explode(part.units(lowered)).alias("_unit"))
            raws = units.select(F.explode(part.tokens_of(F.col("_unit"))).alias("_token")).select(F.col("_token.term").alias("raw"))
        else:
            raws = df.select(F.explode(F.split(lowered, rf"[{_BLANKS}-]", -1)).alias("raw"))
        out = raws if out is None else out.unionByName(raws)
    return out


def explode_tokens(df: DataFrame, language: Language, text: str, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, *keep, ord, raw, start, length) of every token of ``text``; one row
    with a null ``raw`` for a text without any, so that no key is lost.

    ``keep`` are columns that the keys determine.

    Starts come from a running sum within the keys' groups: linear, and no
    array grows in a fold.
    """
    from pyspark.sql import Window

    out = None
    for k, part in enumerate(language.parts):
        lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
        if not part.script:
            # no scripts: what separators part is a token; a separator is one character
            pieces = df.select(*keys, *keep, F.posexplode(F.split(lowered, rf"[{_BLANKS}-]", -1)).alias("_no", "_piece"))
            ahead = Window.partitionBy(*keys).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
            placed = pieces.withColumn("_start", F.coalesce(F.sum(F.length("_piece") + 1).over(ahead), F.lit(0)).cast("int"))
            full = F.col("_piece") != ""
            tokens = placed.where(full | (F.col("_no") == 0)).select(
                *keys,
                *keep,
                F.struct(F.lit(k).alias("language"), F.col("_no").alias("unit"), F.lit(0).alias("no")).alias("ord"),
                F.when(full, F.col("_piece")).alias("raw"),
                F.col("_start").alias("start"),
                F.length("_piece").alias("length"),
            )
            out = tokens if out is None else out.unionByName(tokens)
            continue
        units = df.select(*keys, *keep, F.posexplode_outer(part.units(lowered)).alias("_unit_no", "_unit"))
        before = Window.partitionBy(*keys).orderBy("_unit_no").rowsBetween(Window.unboundedPreceding, -1)
        placed = units.withColumn("_before", F.coalesce(F.sum(F.length("_unit")).over(before), F.lit(0)).cast("int"))
        tokens = placed.select(*keys, *keep, "_unit_no", "_before", F.posexplode_outer(part.tokens_of(F.col("_unit"))).alias("_no", "_token"))
        tokens = tokens.select(
            *keys,
            *keep,
            F.struct(F.lit(k).alias("language"), F.col("_unit_no").alias("unit"), F.col("_no").alias("no")).alias("ord"),
            F.col("_token.term").alias("raw"),
            (F.col("_before") + F.col("_token.at")).alias("start"),
            F.col("_token.length").alias("length"),
        )
        out = tokens if out is None else out.unionByName(tokens)
    if len(language.parts) > 1:
        first = F.min(F.struct("ord", "start", "length")).alias("_t")
        out = out.groupBy(*keys, "raw").agg(first, *[F.first(c).alias(c) for c in keep]).select(*keys, *keep, "_t.ord", "raw", "_t.start", "_t.length")
    return out
