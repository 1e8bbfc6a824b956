"""Numbers inside running text: Chinese characters, hangul and Thai words."""

from __future__ import annotations

import re

from textgauge.functions.wordnumbers import LARGEST

UNITS = {"十": 10, "百": 100, "千": 1000}


class SpanNumbers:
    """Numbers of digits and unit characters around one myriad character.

    A span without units reads digit by digit; one with units adds up digits times units, a unit
    alone counting once. zeros: digits that only fill a place before another digit when there are units.
    strict: several spelled digits in a row before a unit are an approximation, no number.
    """

    def __init__(self, digits: dict[str, int], units: dict[str, int], myriad: str, zeros: str = "", strict: bool = False):
        self.digits, self.units, self.myriad, self.zeros, self.strict = digits, units, myriad, zeros, strict
        self.marks = set(digits) | set(units) | {myriad}
        self.run = re.compile(f"[0-9{''.join(digits)}{''.join(units)}{myriad}]+")
        self.arabic = str.maketrans({c: str(n) for c, n in digits.items()})
        self.pairs = re.compile(f"([^{''.join(units)}]*)([{''.join(units)}]|$)")

    def _span(self, part: str) -> int | None:
        if not self.units.keys() & set(part):
            plain = part.translate(self.arabic)
            return int(plain) if plain.isdecimal() else None
        total = 0
        for digits, unit in self.pairs.findall(part.replace(self.myriad, "")):
            if self.zeros:
                digits = digits.lstrip(self.zeros)
                if set(digits) & set(self.zeros):
                    return None
            if self.strict and len(digits) > 1 and not digits.isdecimal():
                return None
            n = int(digits.translate(self.arabic)) if digits else int(bool(unit))
            total += n * self.units.get(unit, 1)
        return total

    def value(self, run: str) -> int | None:
        head, myriad, tail = run.partition(self.myriad)
        if not myriad:
            return self._span(run)
        if self.strict and self.myriad in tail:
            return None
        times, rest = (self._span(head) if head else 1), (self._span(tail) if tail else 0)
        return None if times is None or rest is None else times * 10000 + rest

    def convert(self, text: str, allowed) -> str:
        """allowed(text, start, end): whether a run may be read as a number at all."""

        def one(m: re.Match) -> str:
            if not self.marks & set(m[0]) or not allowed(text, m.start(), m.end()):
                return m[0]
            n = self.value(m[0])
            return m[0] if n is None or n > LARGEST else str(n)

        return self.run.sub(one, text)


_KANJI = {c: n for n, c in enumerate("零一二三四五六七八九")} | {"〇": 0}
_JA = SpanNumbers(_KANJI, UNITS, "万")
_ZH = SpanNumbers(_KANJI | {"两": 2}, UNITS, "万", zeros="零〇")
#: Words that begin with a numeral but count nothing. Fixed values.
_JA_WORDS = {"一人", "一つ", "一番", "一緒", "一般", "二日"}
_ZH_WORDS = {"一起", "一样", "一直", "一些", "一切", "一般", "一点", "一定", "一共", "一边", "零食", "零钱", "零售", "零件", "十分"}
_IF = {"万一"}


def _bare_units(run: str, start: int, gaps: frozenset[int]) -> bool:
    """Whether a part of the run, cut where spaces stood, is made of units alone."""
    cuts = [0, *sorted(g - start for g in gaps if start < g < start + len(run)), len(run)]
    return any(set(run[a:b]) <= UNITS.keys() | {"万"} for a, b in zip(cuts, cuts[1:]) if a < b)


def _free(words: set[str], gaps: frozenset[int], pair_before_unit: str = ""):
    def allowed(text: str, start: int, end: int) -> bool:
        run = text[start:end]
        if run in _IF or text[start : end + 1] in words or _bare_units(run, start, gaps):
            return False
        return not pair_before_unit or not re.search(f"{pair_before_unit}(?![十百千万])", run)

    return allowed


def japanese(text: str, gaps: frozenset[int] = frozenset()) -> str:
    return _JA.convert(text, _free(_JA_WORDS, gaps))


def chinese(text: str, gaps: frozenset[int] = frozenset()) -> str:
    return _ZH.convert(text, _free(_ZH_WORDS, gaps, "两"))


_KO = SpanNumbers({"공": 0} | {c: n for n, c in enumerate("영일이삼사오육칠팔구")}, {"십": 10, "백": 100, "천": 1000}, "만", strict=True)
#: Words of numeral syllables that are none. Fixed values.
_KO_WORDS = {"만일", "만이", "천사", "만사", "오만"}


def _korean_run(text: str, start: int, end: int) -> bool:
    run, before = text[start:end], text[start - 1 : start] if start else ""
    if run in _KO_WORDS or len(run) < 2 or not set(run) & set("십백천만"):
        return False
    return run[0] in "0123456789" or before == "제" or not "가" <= before <= "힣"


def korean(text: str) -> str:
    return _KO.convert(text, _korean_run)


# --- Thai. The words of the language, with a class letter each.
_TH = {"หนึ่ง": "1", "สอง": "2", "สาม": "3", "สี่": "4", "ห้า": "5", "หก": "6", "เจ็ด": "7", "แปด": "8", "เก้า": "9", "สิบ": "s", "ร้อย": "r", "พัน": "p", "หมื่น": "w", "ยี่": "y", "เอ็ด": "e"}
_TH_WORD = re.compile("|".join(sorted(_TH, key=len, reverse=True)))
_TH_RUN = re.compile(f"(?:{_TH_WORD.pattern})+")
_TH_NUMBER = re.compile("(?:([1-9]?)(w))?(?:([1-9]?)(p))?(?:([1-9]?)(r))?(?:([1-9y]?)(s))?([1-9e]?)")
_TH_SIZES = {"w": 10000, "p": 1000, "r": 100, "s": 10}
#: Words that hold numeral words but count nothing. Fixed values.
_TH_KEPT = ("ห้าม", "สามารถ", "เก้าอี้", "หกล้ม", "พันเอก", "ร้อยเอก", "พันธ", "สัมพันธ", "กองพัน", "สามี", "ห้าง", "สิบเอก", "สามัคคี", "สามัญ", "เรียบร้อย", "โกหก")
#: Signs that belong to the syllable before them.
_TH_SIGNS = {chr(c) for c in (*range(0x0E30, 0x0E3B), *range(0x0E47, 0x0E4F))}


def _thai_value(classes: str) -> int | None:
    m = _TH_NUMBER.fullmatch(classes)
    if m is None or not classes or (m[9] == "e" and len(classes) == 1):
        return None
    digit = lambda c: {"y": 2, "e": 1}.get(c) or int(c)
    pairs = [(m[i], m[i + 1]) for i in (1, 3, 5, 7) if m[i + 1]]
    total = sum((digit(d) if d else 1) * _TH_SIZES[u] for d, u in pairs)
    if m[9] == "e" and not total:
        return None
    return total + (digit(m[9]) if m[9] else 0)


def _thai_free(text: str, start: int, end: int) -> bool:
    if text[end : end + 1] in _TH_SIGNS and end < len(text):
        return False
    # a kept word must not reach from the run's beginning, or before it, over its end
    return not any(text.startswith(w, at) for w in _TH_KEPT for at in range(max(0, end - len(w)), start + 1))


def thai(text: str) -> str:
    out, at = [], 0
    for m in _TH_RUN.finditer(text):
        start, end = m.span()
        if not _thai_free(text, start, end):
            continue
        words = _TH_WORD.findall(m[0])
        classes = "".join(_TH[w] for w in words)
        n = _thai_value(classes)
        if n is None:
            # the longest beginning that is a number with a unit, unless what follows it is one by itself
            k = next((k for k in range(len(words) - 1, 0, -1) if _thai_value(classes[:k]) is not None), 0)
            if not k or not set(classes[:k]) & set("wprs") or _thai_value(classes[k:]) is not None:
                continue
            end = start + len("".join(words[:k]))
            if not _thai_free(text, start, end):
                continue
            n = _thai_value(classes[:k])
        out += [text[at:start], str(n)]
        at = end
    return "".join([*out, text[at:]])
