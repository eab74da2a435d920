"""Romanisation of Indic scripts by one table: the nine blocks are laid out alike, 128 code points each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First code points of the blocks: Devanagari, Bengali, Gurmukhi, Gujarati, Oriya, Tamil, Telugu, Kannada, Malayalam.
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
INDIC = "[ऀ-෿]"

# The ITRANS romanisation by place in a block.
_VOWELS = dict(zip(range(0x05, 0x15), ("a", "A", "i", "I", "u", "U", "RRi", "LLi", "e", "e", "e", "ai", "o", "o", "o", "au"), strict=True))
_CONSONANTS = dict(zip(range(0x15, 0x3A), ("k", "kh", "g", "gh", "~N", "ch", "Ch", "j", "jh", "~n", "T", "Th", "D", "Dh", "N", "t", "th", "d", "dh", "n", "n", "p", "ph", "b", "bh", "m", "y", "r", "r", "l", "L", "L", "v", "sh", "Sh", "s", "h"), strict=True))
_SIGNS = dict(zip(range(0x3E, 0x4D), ("A", "i", "I", "u", "U", "RRi", "RRI", "e", "e", "e", "ai", "o", "o", "o", "au"), strict=True))
_MARKS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x70: "M"}
_VIRAMA = 0x4D
#: Replacements towards English spelling, in order.
_SQUASH = (("aa", "a"), ("ii", "i"), ("uu", "u"), ("~n", "n"), ("sh", "s"), ("ph", "f"), ("chh", "ch"), ("^", ""))


def _word(word: str) -> str:
    """One word, by the block of its first Indic character; other characters stay."""
    base = next((b for c in word for b in BLOCKS if b <= ord(c) < b + 128), None)
    if base is None:
        return word
    out: list[str] = []
    open_vowel = False  # the last consonant still carries its own a
    for c in word:
        place = ord(c) - base
        if not 0 <= place < 128:
            out.append(("a" if open_vowel else "") + c)
            open_vowel = False
        elif place in _CONSONANTS:
            out.append(("a" if open_vowel else "") + _CONSONANTS[place])
            open_vowel = True
        elif place in _SIGNS:
            out.append(_SIGNS[place])
            open_vowel = False
        elif place == _VIRAMA:
            open_vowel = False
        elif place == 0x3C:
            continue
        else:
            tail = _VOWELS.get(place) or _MARKS.get(place) or (str(place - 0x66) if 0x66 <= place < 0x70 else c)
            out.append(("a" if open_vowel else "") + tail)
            open_vowel = False
    return "".join(out) + ("a" if open_vowel else "")


def romanise(text: str) -> str:
    """Lower-cased romanisation of a string with Indic characters."""
    out = " ".join(map(_word, text.split(" "))).lower()
    for a, b in _SQUASH:
        out = out.replace(a, b)
    return out


@F.pandas_udf(T.StringType())
def _romanised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        found = texts.str.contains(INDIC, regex=True, na=False)
        if found.any():
            texts = texts.copy()
            texts[found] = texts[found].map(romanise)
        yield texts


@F.pandas_udf(T.StringType())
def decompose(texts: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition (NFKD), for which Spark has no function; ASCII strings are left alone."""
    return texts.str.normalize("NFKD")


def romanised(text: Column) -> Column:
    return _romanised(text)
