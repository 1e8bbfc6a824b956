"""SQL twins of the normalizers, for texts in which spelled numbers stand alone.

They restate the rules by other means (no lookaround, word by word instead of a grammar), so that
whole tables can be compared with the Python functions. Runs of several number words, which the
tables at hand do not hold, are left to the published expectations in `goldens`.
"""

from __future__ import annotations

import numpy as np

from textgauge.functions import english

_APOSTROPHE, _POINT, _JOINED = "chr(57344)", "chr(57345)", "chr(57346)"
_SPACES = r"\s\x{A0}\x{0B}\x{85}\x{2028}\x{2029}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{1C}-\x{1F}"


def _twice(x: str, pattern: str, by: str) -> str:
    """Neighbouring matches share a character, which two passes see to."""
    return f"regexp_replace(regexp_replace({x}, '{pattern}', {by}, 'g'), '{pattern}', {by}, 'g')"


def _fold(x: str) -> str:
    return f"replace(lower(nfc_normalize({x})), 'ß', 'ss')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SPACES}]+', ' ', 'g'))"


def _blank(x: str, point: bool = False, more: str = "") -> str:
    x = _twice(x, r"([\pL\pN_])''([\pL\pN_])", rf"'\1' || {_APOSTROPHE} || '\2'")
    if point:
        x = _twice(x, r"(\d)\.(\d)", rf"'\1' || {_POINT} || '\2'")
    return f"replace(replace(regexp_replace({x}, '[\\pP\\pS{more}]', ' ', 'g'), {_APOSTROPHE}, ''''), {_POINT}, '.')"


def _groups(x: str, separator: str) -> str:
    """Digits in groups of three are joined; the mark set between them keeps a group's end in sight of the next pass."""
    for _ in range(4):
        x = rf"regexp_replace({x}, '(\d){separator}(\d\d\d)([^\d]|$)', '\1' || {_JOINED} || '\2\3', 'g')"
    return f"replace({x}, {_JOINED}, '')"


def _each(x: str, words: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items())
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def _english_words() -> dict[str, str]:
    """Words that stand alone: titles written out, number words in digits, a one as a word."""
    out = dict(english._TITLES)
    names = {**english._UNITS, **english._TENS, **{w: n for w, n in english._SCALES.items() if n < 10**6}}
    for word, n in names.items():
        ordinal = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}.get(word, (word[:-1] + "ie" if word.endswith("y") else word) + "th")
        plural = word[:-1] + "ies" if word.endswith("y") else word + "s"
        out |= {word: str(n), ordinal: str(n), plural: f"{n}s"}
    return {w: {"1": "one", "1s": "ones"}.get(n, n) for w, n in out.items()} | {"oh": "0", "o": "0"}


def english_sql(x: str) -> str:
    x = _squeeze(_blank(_twice(_fold(x), r"(\d),(\d)", r"'\1\2'")))
    x = rf"regexp_replace(regexp_replace({x}, '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g')"
    x = rf"regexp_replace({x}, '([0-9]) (st|nd|rd|th|s)\b', '\1\2', 'g')"
    x = rf"regexp_replace({_each(x, _english_words())}, '\b(\d+)(st|nd|rd|th)\b', '\1', 'g')"
    return rf"regexp_replace({x}, '\b1(s?)\b', 'one\1', 'g')"


_GERMAN = {w: str(i) for i, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf".split())}


def western_sql(x: str, lang: str) -> str:
    """German, French or Spanish."""
    x = _fold(x)
    if lang == "de":
        x = _groups(x, "''")
    x = _twice(x, r"(\d),(\d)", r"'\1.\2'")
    x = _squeeze(_blank(_groups(x, r"[ \x{A0}\x{202F}]" if lang == "fr" else r"\."), True))
    if lang == "es":
        x = rf"regexp_replace({x}, '\b(\d+)(?:[oa]s?)\b', '\1', 'g')"
    if lang == "fr":
        x = rf"regexp_replace({x}, '\b(\d+)(?:ères?|eres?|ers?|res?|èmes?|emes?|e)\b', '\1', 'g')"
    if lang == "de":
        x = f"array_to_string(list_transform(string_split({_each(x, _GERMAN)}, ' '), lambda w: CASE WHEN regexp_full_match(w, '(erst|einst|einsst)e[nrsm]?') THEN '1' ELSE w END), ' ')"
    x = _squeeze(_blank(x, True, r"\pM"))
    return _groups(x, " ") if lang == "fr" else x


def normal_sql(lang: str, x: str) -> str:
    return f"CASE {lang} WHEN 'en' THEN {english_sql(x)} " + " ".join(f"WHEN '{k}' THEN {western_sql(x, k)}" for k in ("de", "es", "fr")) + " END"


def draws_sql(n: int, seed: int, sizes: str) -> str:
    """Common table `draws` (size, resample, pos): the published index stream of n resamples for every size in `sizes` (a query of one column `size`).

    The generator's 128-bit state moves in four limbs of 32 bits; its output is rotated, halved and mapped to indexes, those that
    the generator would reject left out. A size of 1 draws nothing and always means its only row.
    """
    start = np.random.PCG64(seed).state["state"]
    limbs = lambda x: [(x >> (32 * i)) & 0xFFFFFFFF for i in range(4)]
    # the multiplier of the published generator, a fixed value
    a, c, s = limbs(0x2360ED051FC65DA44385DF649FCCF645), limbs(start["inc"]), limbs(start["state"])
    b = "4294967296::HUGEINT"
    inner = "SELECT i, s0, s1, s2, s3 FROM g, need WHERE i < m"
    for k in range(4):
        carry = f" + r{k - 1} // {b}" if k else ""
        inner = f"SELECT *, {' + '.join(f's{k - j} * {a[j]}::HUGEINT' for j in range(k + 1))} + {c[k]}{carry} AS r{k} FROM ({inner})"
    return f"""
    sizes AS ({sizes}),
    need AS (SELECT coalesce(max(size), 0) * {n} // 2 + 64 AS m FROM sizes),
    g(i, s0, s1, s2, s3) AS (SELECT 0::BIGINT, {', '.join(f'{x}::HUGEINT' for x in s)} UNION ALL SELECT i + 1, {', '.join(f'r{k} % {b}' for k in range(4))} FROM ({inner})),
    mixed AS (SELECT i, xor(s3 * {b} + s2, s1 * {b} + s0) AS x, (s3 // 67108864)::INTEGER AS turn FROM g WHERE i > 0),
    turned AS (SELECT i, x // (1::HUGEINT << turn) + (x % (1::HUGEINT << turn)) * (1::HUGEINT << (64 - turn)) AS x FROM mixed),
    halves AS (SELECT 2 * i AS h, x % {b} AS u FROM turned UNION ALL SELECT 2 * i + 1, x // {b} FROM turned),
    kept AS (SELECT size, row_number() OVER (PARTITION BY size ORDER BY h) - 1 AS k, (u * size // {b})::BIGINT AS pos FROM halves, sizes WHERE size > 1 AND u * size % {b} >= {b} % size),
    draws AS (SELECT size, k // size AS resample, pos FROM kept WHERE k < {n} * size UNION ALL SELECT 1, k, 0 FROM range({n}) r(k) WHERE 1 IN (SELECT size FROM sizes))"""
