"""Splitting text into the pre-tokens of the byte-level vocabularies."""

from __future__ import annotations

import re

import public_tokenizers
import regex

#: Texts of these characters only: here the standard ``re`` module's classes are the same as the Unicode ones of the pattern.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±´-¸»¿-ɏ‐-‧‰-⁞₠-₿]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_FULL = regex.compile(public_tokenizers.PATTERN)


def is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


def pretokens(text: str) -> list[str]:
    """The matches of ``public_tokenizers.PATTERN``, in order; together they are the text."""
    return (_FAST if is_plain(text) else _FULL).findall(text)
