"""Normal forms of plain texts, by one table of bytes.

A text is plain, by class of its characters, if it consists of letters of ASCII and Latin-1, ASCII white space and marks (no
apostrophe), and some quotation marks and dashes. It then has no digit, nothing that compatibility forms or case
folding treat in another way than lower-casing (but for the sharp s), and no mark that is ever kept. So every rule on digits, apostrophes,
points and combining marks leaves it alone, and what remains is lower-casing, blanks for marks, one space, and the
rules on words. Rules that look at one word at a time (German numbers; English fillers, titles, spellings and short forms) are applied;
where a word is there that a rule on several words begins with, the text is left to the rules as a whole. All this is
seen in a code page of one byte a character, at a small part of the cost of the rules.
"""

from __future__ import annotations

import functools
from itertools import product

from textgauge.functions import english, wordnumbers

#: Has Latin-1's letters, and the quotation marks and dashes.
_PAGE = "cp1252"
_LETTERS = "".join(chr(c) for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'") + "«»“”„–—…¿¡"
_BLANKS = " \t\n\x0b\x0c\r"
_ALLOWED = (_LETTERS + _MARKS + _BLANKS).encode(_PAGE)
_TABLE = bytes.maketrans((_LETTERS + _MARKS).encode(_PAGE), (_LETTERS.replace("ß", "\1").lower().replace("\1", "ß") + " " * len(_MARKS)).encode(_PAGE))
def idle_classes(grammar: wordnumbers.WordGrammar) -> set[str]:
    """Word classes of a grammar that no number consists of alone: "and", "one" and the like, which only count beside others."""
    idle = {kind for kind, _ in grammar.words.values() if not any(m[0] for m in grammar.pattern.finditer(kind))}
    while True:
        found = {c for n in (2, 3) for word in product(sorted(idle | {"."}), repeat=n) if any(m[0] for m in grammar.pattern.finditer("".join(word))) for c in word if c != "."}
        if not found:
            return idle
        idle -= found


@functools.cache
def starting_words(lang: str) -> frozenset[bytes]:
    """Words without which no rule on several words does anything, in the code page."""
    if lang == "de":
        return frozenset()
    if lang == "en":
        words = set(english._STARTS)
    else:
        grammar = {"es": wordnumbers.SPANISH, "pt": wordnumbers.PORTUGUESE, "fr": wordnumbers.FRENCH}[lang]
        idle = idle_classes(grammar)
        words = {w for w, (kind, _) in grammar.words.items() if kind not in idle}
    return frozenset(w.encode(_PAGE) for w in words)


_replaced: tuple[int, dict[bytes, bytes | None]] = (0, {})


def _english_words() -> dict[bytes, bytes | None]:
    """English words that are replaced one by one, fillers by nothing; None where what comes begins a number. Made anew where other spellings are in use."""
    global _replaced
    if _replaced[0] != id(english.spellings):
        words = {w: english.written_out(w) for t in (english._FILLERS, english._WHOLE, english._TITLES, english.spellings) for w in t}
        sure = {w: new.isascii() and english._STARTS.isdisjoint(new.split(" ")) for w, new in words.items()}
        _replaced = (id(english.spellings), {w.encode(_PAGE, "replace"): new.encode() if sure[w] else None for w, new in words.items()})
    return _replaced[1]


def plain_form(lang: str, text: str) -> str | None:
    """The normal form of a plain text of en, de, es, fr or pt; None for any other text, which is for the rules to normalize."""
    if lang not in ("en", "de", "es", "fr", "pt"):
        return None
    try:
        raw = text.encode(_PAGE)
    except UnicodeEncodeError:
        return None
    if raw.translate(None, _ALLOWED):
        return None
    words = raw.translate(_TABLE).replace(b"\xdf", b"ss").split()
    if not starting_words(lang).isdisjoint(words):
        return None
    if lang == "de":
        return wordnumbers.german(b" ".join(words).decode(_PAGE))
    if lang == "en" and not (table := _english_words()).keys().isdisjoint(words):
        words = [table.get(w, w) for w in words]
        if None in words:
            return None
        words = [w for w in words if w]
    return b" ".join(words).decode(_PAGE)
