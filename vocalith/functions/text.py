"""Text identities. Each is a different definition of when two texts are the same; they are not interchangeable."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

NOT_WORD = r"[^\p{L}\p{N}\p{M}]"


def text_key(text: Column) -> Column:
    """Lower case; letters, digits and marks; anything else is one space."""
    return F.trim(F.regexp_replace(F.lower(text), f"{NOT_WORD}+", " "))


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_chars(text: Column) -> Column:
    """Letters, digits and marks."""
    return F.length(F.regexp_replace(text, NOT_WORD, ""))


#: Devanagari letters that hold a nukta, and the letters without it.
NUKTA_LETTERS = "\u0929\u0931\u0934\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f", "\u0928\u0930\u0933\u0915\u0916\u0917\u091c\u0921\u0922\u092b\u092f"


@functools.cache
def unstable() -> str:
    """A pattern for text that composition can change: letters that it replaces, marks that it joins to a letter before them, and
    marks in a row, whose order it can change."""
    found: set[int] = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # parts of Hangul syllables
    for c in range(0x300, 0x30000):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<":
            found |= {int(x, 16) for x in parts.split()[1:]}
            if unicodedata.normalize("NFC", chr(c)) != chr(c):
                found.add(c)
    runs: list[list[int]] = []
    for c in sorted(found):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + r"]|\p{M}\p{M}"


def nfc(text: Column) -> Column:
    """Unicode composition. Spark has no function for it, so texts that it can change, and only those, go through Python."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(composed(F.when(text.rlike(unstable()), text)), text)


def nfc_all(texts: Column) -> Column:
    """``nfc`` of each text of an array."""

    @F.pandas_udf("array<string>")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFC", t) for t in ts])

    return F.coalesce(composed(F.when(F.exists(texts, lambda t: F.coalesce(t.rlike(unstable()), F.lit(False))), texts)), texts)


def cer_clean(text: Column) -> Column:
    """Composed lower case, without nukta, candrabindu as anusvara; letters, marks and digits only, no spaces."""
    return F.regexp_replace(F.replace(F.replace(nfc(F.lower(text)), F.lit("़"), F.lit("")), F.lit("ँ"), F.lit("ं")), NOT_WORD, "")


def cer_clean_legacy(text: Column) -> Column:
    """As ``cer_clean``, without combining marks."""
    return F.regexp_replace(F.replace(nfc(F.lower(text)), F.lit("़"), F.lit("")), r"[^\p{L}\p{N}]", "")


def _bare(text: Column) -> Column:
    return F.replace(F.translate(text, *NUKTA_LETTERS), F.lit("़"), F.lit(""))


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("ँ"), F.lit("ं"))), r"[\p{P}\p{S}\p{Z}\p{C}]+", " "))


def canon(text: Column) -> Column:
    """Composed lower case without nukta, candrabindu as anusvara; punctuation, symbols, separators and controls become one space."""
    return _folded(nfc(_bare(text)))


def canon_all(texts: Column) -> Column:
    """``canon`` of each text of an array."""
    return F.transform(nfc_all(F.transform(texts, _bare)), _folded)


def words(text: Column) -> Column:
    """Words without punctuation and symbols; case is kept. Null and blank texts have none."""
    bare = F.trim(F.regexp_replace(F.replace(text, F.lit("़"), F.lit("")), r"[\p{P}\p{S}\s]+", " "))
    return F.coalesce(F.array_remove(F.split(bare, " "), ""), F.expr("cast(array() as array<string>)"))


def corpus_norm(text: Column) -> Column:
    """Without white space and sentence marks; case is kept."""
    return F.regexp_replace(text, r"[\s\x{964}.,?!]+", "")


#: Distances up to which an edit distance is first sought: a band of the table costs its width, the whole table the square of the length.
NEAR = (16, 64, 256)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance: in narrow bands first, which near texts need only, in the whole table for texts that are far apart."""
    found = lambda n: F.get(F.filter(F.array(F.levenshtein(a, b, n)), lambda d: d >= 0), F.lit(0))
    return F.coalesce(*[found(n) for n in NEAR], F.levenshtein(a, b))


def error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's length; an empty reference is 0 against an empty text, else 1. Can exceed 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(ref, hyp) / F.length(ref))


def bounded_error(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's length, between 0 and 1."""
    return F.least(F.lit(1.0), edit_distance(ref, hyp) / F.greatest(F.lit(1), F.length(ref)))
