"""Character-level rules shared by the languages, as plain functions of one text.

Python's Unicode tables are the canonical ones here; `textgauge.functions.native` has built-in
expressions for the rules where the JVM's tables cannot differ.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable

#: An apostrophe between word characters and a point between digits; captured, so that a split at them keeps them.
_APOSTROPHE, _POINT = r"(?<=\w)'(?=\w)", r"(?<=\d)\.(?=\d)"


@functools.cache
def _blanks(kinds: str) -> dict[int, str]:
    """A translation table that sends every character of the given major categories to a space."""
    return {c: " " for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds}


def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def blank_marks(text: str) -> str:
    """Punctuation and symbols to spaces, one each."""
    return text.translate(_blanks("PS"))


def _between(text: str, kept: list[str], change: Callable[[str], str]) -> str:
    """`change` applied to what lies between the marks that match one of the patterns `kept`."""
    if not kept:
        return change(text)
    parts = re.split(f"({'|'.join(kept)})", text)
    parts[::2] = map(change, parts[::2])
    return "".join(parts)


def blank_marks_but(text: str, apostrophe: bool = True, point: bool = False) -> str:
    """As blank_marks, but apostrophes between word characters and, if asked, points between digits stay."""
    kept = [pattern for wanted, pattern in ((apostrophe, _APOSTROPHE), (point, _POINT)) if wanted]
    return _between(text.replace("’", "'"), kept, blank_marks)


def one_space(text: str) -> str:
    return " ".join(text.split()) if text.isascii() else re.sub(r"\s+", " ", text).strip()


def fold_basic(text: str) -> str:
    """The basic layer of the published recogniser's normalizer, as far as it reaches cleaned text: combining marks, symbols and punctuation to spaces, but not kept marks."""
    return one_space(_between(text, [_APOSTROPHE, _POINT], lambda part: nfkc(part.lower()).translate(_blanks("MPS"))))


def join_comma_groups(text: str) -> str:
    return re.sub(r"(?<=\d),(?=\d)", "", text)


def join_ascii_comma_groups(text: str) -> str:
    return re.sub("(?<=[0-9])[,，](?=[0-9])", "", text)


def join_groups(text: str, mark: str) -> str:
    """Drop a mark between a digit and a last group of exactly three; `mark` is a class or an escaped character."""
    return re.sub(rf"(?<=\d){mark}(?=\d{{3}}(?!\d))", "", text)


def comma_to_point(text: str) -> str:
    return re.sub(r"(?<=\d),(?=\d)", ".", text)


def bare_ordinals(text: str, endings: str) -> str:
    return re.sub(rf"\b(\d+)(?:{endings})\b", r"\1", text)


def thai_digits(text: str) -> str:
    return text.translate({0x0E50 + d: str(d) for d in range(10)})


def long_vowels(text: str) -> str:
    """Dashes that follow kana become the long-vowel mark, however many stand in a row."""
    return re.sub("(?<=[぀-ゟ゠-ヿ])[‐‑‒–—―−-]+", lambda m: "ー" * len(m[0]), text)


def without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def close_up(text: str) -> tuple[str, frozenset[int]]:
    """The text without spaces, and the offsets in it where spaces stood."""
    parts = text.split(" ")
    ends, at = set(), 0
    for part in parts[:-1]:
        at += len(part)
        ends.add(at)
    return "".join(parts), frozenset(ends)
