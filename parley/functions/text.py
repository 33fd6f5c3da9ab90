"""Column functions on turn texts. Java's \\b, \\w and \\s are made Unicode, as the metrics are defined so."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import lexicon as lx


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has(text: Column, pattern: str, flags: str = "iU") -> Column:
    return text.rlike(f"(?{flags}){pattern}")


def count(text: Column, pattern: str, flags: str = "iU") -> Column:
    return F.regexp_count(text, F.lit(f"(?{flags}){pattern}")).cast("long")


def first_at(text: Column, pattern: str, flags: str = "iU") -> Column:
    """Place of the first match, from 1; 0 without one. regexp_instr counts empty text as no match."""
    return F.regexp_instr(text, F.lit(f"(?{flags}){pattern}"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_lower(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def normal(text: Column) -> Column:
    """For repeats: small letters, nothing but a-z, 0-9 and blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def tokens(text: Column) -> Column:
    """ASCII word tokens in small letters; accented letters part words."""
    return F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z']+)"), F.lit(1)), lambda t: F.lower(t))


def content_ratio(text: Column) -> Column:
    """Share of words that aren't stop words, punctuation attached; null without words."""
    stop = F.array(*map(F.lit, lx.STOP_WORDS))
    return let(words(F.lower(text)), lambda ws: F.try_divide(F.size(F.filter(ws, lambda w: ~F.array_contains(stop, w))), F.size(ws)))


def opens_with_agreement(text: Column) -> Column:
    """One of the tokens at the very start of the turn."""
    return has(text, r"^\s*(?:" + "|".join(lx.SYCOPHANCY_OPENERS) + r")\b")


def phrase_count(text: Column) -> Column:
    """Occurrences of each phrase, added; phrases within phrases count for both."""
    low = F.lower(text)
    return sum((F.regexp_count(low, F.lit(r"\Q" + p + r"\E")).cast("long") for p in lx.SYCOPHANCY_PHRASES), F.lit(0).cast("long"))


def is_fragment(text: Column) -> Column:
    n = n_words(text)
    return (n >= 1) & (n <= 3) & ~has(text, r"[.?!]\s*$", "U")


@cache
def latin_letters() -> tuple[tuple[int, int], ...]:
    """Ranges of the letters that have LATIN in their names. Ordinal signs and modifier letters have not, though they
    are of the Latin script; full-width and mathematical letters differ from it too."""
    out: list[list[int]] = []
    for c in range(0x41, 0x1E000):
        if chr(c).isalpha() and "LATIN" in unicodedata.name(chr(c), "LATIN"):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return tuple(map(tuple, out))


def latin_class() -> str:
    """latin_letters inside the brackets of a pattern."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in latin_letters())


def is_drift(text: Column, spanish=lx.DRIFT_WORDS, foreign_script: bool = True) -> Column:
    """Spanish function words or, unless switched off, any letter without LATIN in its name."""
    few = count(text, lx.words(spanish)) >= lx.DRIFT_HITS
    return few | text.rlike(rf"[\p{{L}}&&[^{latin_class()}]]") if foreign_script else few


def strip_residue(text: Column) -> Column:
    """The turn up to the first template or end-of-session residue."""
    at = first_at(text, lx.RESIDUE, "imU")
    cut = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return strip(F.regexp_replace(strip(cut), '^"+|"+$', ""))


def first_utterance(text: Column) -> Column:
    """struct(text, ran_past): leading labels peeled, cut at the first label inside, outer quotes removed."""
    peeled = F.regexp_replace(strip(text), rf"(?iU)^(?:\s*{lx.LEAD_LABEL})+", "")

    def cut(t: Column) -> Column:
        at = first_at(t, lx.INNER_LABEL)
        kept = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
        return F.struct(F.regexp_replace(strip(kept), '^"+|"+$', "").alias("text"), (at > 0).alias("ran_past"))

    return let(peeled, cut)


def clean_markup(raw: Column) -> Column:
    """Transcript markup away, spoken words kept."""
    t = F.regexp_replace(raw, lx.MARKUP_NOTE, " ")
    t = F.regexp_replace(t, f"(?U){lx.MARKUP_OPENING}", " ")
    t = F.translate(t, lx.MARKUP_BRACKETS, " " * len(lx.MARKUP_BRACKETS))
    t = F.regexp_replace(t, lx.MARKUP_END, " ")
    t = strip(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.regexp_replace(t, f"(?U){lx.SPACE_BEFORE_MARK}", "$1")


def tsv_safe(text: Column, strict: bool = True) -> Column:
    """For tab-separated output: tabs to blanks; strict also takes line ends and quotes out."""
    return F.trim(F.translate(text, '\n\r\t"', "   ")) if strict else F.translate(text, "\t", " ")


def section(turn_index: Column, n_turns: Column) -> Column:
    return F.when(turn_index < n_turns / 2, "Earlier").otherwise("Later")


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and small letters after it, also behind hyphens and apostrophes."""
    return F.array_join(F.transform(F.regexp_extract_all(strip(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda p: F.initcap(p)), "")


def to_float(text: Column) -> Column:
    """Empty texts, NaN and what isn't a number become null."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normal(v: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
