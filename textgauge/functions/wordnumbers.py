"""Spelled numbers of languages that write words apart, by grammars over word classes.

Each word is replaced by one letter for its class ("." for anything else), so that a text becomes a
string of classes; numbers are then matched by a regular expression over that string and valued
from what their groups captured. A grammar's atomic groups take as many words as they can, and a
match may be marked to stand as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from textgauge.functions.text import nfkc, without_accents

LARGEST = 99_999


class WordGrammar:
    """words: word to (class, value). value: from the match and the list of values at its words; None leaves the words alone."""

    def __init__(self, words: dict[str, tuple[str, int]], pattern: str, value: Callable[[re.Match, list[int]], int | None]):
        self.words, self.pattern, self.value = words, re.compile(pattern, re.VERBOSE), value

    def convert(self, text: str) -> str:
        tokens = text.split(" ")
        known = [self.words.get(t) for t in tokens]
        if not any(known):
            return text
        classes = "".join(k[0] if k else "." for k in known)
        values = [k[1] if k else 0 for k in known]
        out, at = [], 0
        for m in self.pattern.finditer(classes):
            if m.end() == m.start():
                continue
            out += tokens[at : m.start()]
            n = self.value(m, values)
            out += tokens[m.start() : m.end()] if n is None or n > LARGEST else [str(n)]
            at = m.end()
        return " ".join(out + tokens[at:])


def _classed(**groups: dict[str, int]) -> dict[str, tuple[str, int]]:
    return {word: (kind[-1], n) for kind, words in groups.items() for word, n in words.items()}


def _unaccented(words: dict[str, int]) -> dict[str, int]:
    return {without_accents(w): n for w, n in words.items()} | words


def _forms(stems: dict[str, int], endings: str = "o a os as") -> dict[str, int]:
    return {s + e: n for s, n in stems.items() for e in endings.split()}


def _numbered(first: int, names: str, step: int = 1) -> dict[str, int]:
    return {w: first + i * step for i, name in enumerate(names.split()) for w in name.split("/")}


# --- Spanish. The words of the language.
_es = _classed(
    z={"cero": 0},
    t=_unaccented(_numbered(10, "diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno/veintiún/veintiuna veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve")),
    d=_numbered(30, "treinta cuarenta cincuenta sesenta setenta ochenta noventa", 10),
    y={"y": 0},
    u=_numbered(1, "uno dos tres cuatro cinco seis siete ocho nueve"),
    a={"un": 1, "una": 1, "ún": 1},
    c={"cien": 100},
    h={"ciento": 100} | _numbered(200, "doscientos/doscientas trescientos/trescientas cuatrocientos/cuatrocientas quinientos/quinientas seiscientos/seiscientas setecientos/setecientas ochocientos/ochocientas novecientos/novecientas", 100),
    m={"mil": 1000},
    O=_unaccented(_forms(_numbered(10, "décim vigésim trigésim cuadragésim quincuagésim sexagésim septuagésim octogésim nonagésim centésim", 10) | {"milésim": 1000})),
    o=_unaccented(_forms({"primer": 1, "tercer": 3, "quint": 5, "sext": 6, "séptim": 7, "octav": 8, "noven": 9}) | {"primer": 1, "tercer": 3}),
    s=_unaccented(_forms({"undécim": 11, "duodécim": 12})),
    q={w: 0 for w in "segundo segunda segundos segundas cuarto cuarta cuartos cuartas".split()},
)
def _romance(words: dict[str, tuple[str, int]], tail: str, head: str, rest: str, joint: str = "") -> WordGrammar:
    """head words, the thousand word m and rest words; or one of the forms in `tail`, of which the group `kept` stays as it is."""
    pattern = rf"(?P<head>(?>{head}))(?:(?P<k>m)(?:{joint}(?P<rest>(?>{rest})))?)?|(?P<k2>m)(?:{joint}(?P<rest2>(?>{rest})))?|{tail}"

    def value(m: re.Match, values: list[int]) -> int | None:
        span = lambda name: sum(values[m.start(name) : m.end(name)]) if m[name] else 0
        if m.groupdict().get("asis"):
            return None
        if m["k2"]:
            return 1000 + span("rest2")
        if m["k"]:
            return span("head") * 1000 + span("rest")
        return sum(values[m.start() : m.end()])

    return WordGrammar(words, pattern, value)


_ES_HEAD, _ES_BEHIND = r"z|t|d(?:y[ua])?|u", r"z|t|d(?:y[ua])?|[ua]"
SPANISH = _romance(_es, r"(?P<asis>Oq)|Oo?|o|s", rf"h(?:{_ES_BEHIND})?|c|{_ES_HEAD}", rf"h(?:{_ES_BEHIND})?|c|{_ES_BEHIND}")

# --- Portuguese. The words of the language.
_pt = _classed(
    z={"zero": 0},
    t=_numbered(10, "dez onze doze treze catorze/quatorze quinze dezesseis/dezasseis dezessete/dezassete dezoito dezenove/dezanove"),
    d=_numbered(20, "vinte trinta quarenta cinquenta sessenta setenta oitenta noventa", 10),
    e={"e": 0},
    u=_unaccented(_numbered(2, "dois/duas três quatro cinco seis sete oito nove")),
    a={"um": 1, "uma": 1},
    c={"cem": 100},
    h={"cento": 100} | _numbered(200, "duzentos/duzentas trezentos/trezentas quatrocentos/quatrocentas quinhentos/quinhentas seiscentos/seiscentas setecentos/setecentas oitocentos/oitocentas novecentos/novecentas", 100),
    m={"mil": 1000},
    O=_unaccented(_forms(_numbered(10, "décim vigésim trigésim quadragésim quinquagésim sexagésim septuagésim/setuagésim octogésim nonagésim centésim", 10) | {"milésim": 1000})),
    o=_unaccented(_forms({"primeir": 1, "terceir": 3, "sétim": 7, "oitav": 8, "non": 9}) | {"quinto": 5, "quintos": 5, "sexto": 6, "sextos": 6}),
    q={w: 0 for w in "segundo segunda segundos segundas quarto quarta quartos quartas quinta quintas sexta sextas".split()},
)
_PT_HEAD, _PT_BEHIND = r"z|t|d(?:e[ua])?|u", r"z|t|d(?:e[ua])?|[ua]"
PORTUGUESE = _romance(_pt, r"(?P<asis>Oq)|Oo?|o", rf"h(?:e(?:{_PT_BEHIND}))?|c|{_PT_HEAD}", rf"h(?:e(?:{_PT_BEHIND}))?|c|{_PT_BEHIND}", "e?")

# --- French. The words of the language.
_FR_STEMS = {"deux": 2, "trois": 3, "quatr": 4, "quatre": 4, "cinqu": 5, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuv": 9, "neuf": 9}
_FR_TEEN_STEMS = {"dix": 10, "onz": 11, "onze": 11, "douz": 12, "douze": 12, "treiz": 13, "treize": 13, "quatorz": 14, "quatorze": 14, "quinz": 15, "quinze": 15, "seiz": 16, "seize": 16}
_FR_TEN_STEMS = {"trent": 30, "trente": 30, "quarant": 40, "quarante": 40, "cinquant": 50, "cinquante": 50, "soixant": 60, "soixante": 60, "septant": 70, "septante": 70, "huitant": 80, "huitante": 80, "octant": 80, "octante": 80, "nonant": 90, "nonante": 90}
_fr_th = lambda stems: _forms(stems, "ième ièmes ieme iemes")
_fr = _classed(
    z=_unaccented({"zéro": 0}),
    u={"deux": 2, "trois": 3, "cinq": 5, "six": 6},
    f={"quatre": 4},
    s={"sept": 7, "huit": 8, "neuf": 9},
    a={"un": 1, "une": 1},
    X={"dix": 10},
    E={"onze": 11},
    t=_numbered(12, "douze treize quatorze quinze seize"),
    V={"vingt": 20},
    v={"vingts": 20},
    d={"trente": 30, "quarante": 40, "cinquante": 50, "septante": 70, "huitante": 80, "octante": 80, "nonante": 90},
    L={"soixante": 60},
    e={"et": 0},
    C={"cent": 100, "cents": 100},
    m={"mille": 1000},
    p=_unaccented({"premier": 1, "premiers": 1, "première": 1, "premières": 1}),
    n=_fr_th({"un": 1, "uni": 1}) | {"unième": 1, "unièmes": 1, "unieme": 1, "uniemes": 1},
    i=_fr_th(_FR_STEMS),
    j=_fr_th(_FR_TEEN_STEMS),
    w=_fr_th({"vingt": 20}),
    k=_fr_th(_FR_TEN_STEMS),
    K=_fr_th({"cent": 100, "mill": 1000, "mille": 1000}),
)
_FR_TEEN, _FR_UNIT = "Xs|[XEt]", "[ufs]"
_FR_HEAD = rf"z|fw|f[Vv](?:{_FR_UNIT}|a|{_FR_TEEN}|[pnij])?|L(?:e[aE]|{_FR_TEEN}|{_FR_UNIT}|[pnij])?|[Vd](?:e[an]|{_FR_UNIT}|[pni])?|{_FR_TEEN}|{_FR_UNIT}"
_FR_BEHIND = rf"{_FR_HEAD}|[anijwk]"
_FR_HUNDREDS = rf"{_FR_UNIT}?C(?:{_FR_BEHIND})?"
_FR_TAIL = rf"(?:ea|en|(?>{_FR_HUNDREDS}|{_FR_BEHIND}))"


def _fr_below_thousand(classes: str, values: list[int]) -> int:
    """Hundreds times their unit, fourscore for four twenties, the rest added up."""
    if "C" in classes:
        at = classes.index("C")
        return (sum(values[:at]) or 1) * 100 + _fr_below_thousand(classes[at + 1 :], values[at + 1 :])
    return sum(values) + (56 if classes[:2] in ("fV", "fv", "fw") else 0)


def _fr_value(m: re.Match, values: list[int]) -> int:
    part = lambda name: _fr_below_thousand(m[name], values[m.start(name) : m.end(name)]) if m[name] else 0
    if m["m"]:
        return (part("head") if m["head"] is not None else 1) * 1000 + part("rest")
    return _fr_below_thousand(m[0], values[m.start() : m.end()])


FRENCH = WordGrammar(_fr, rf"(?P<head>(?>{_FR_HUNDREDS}|{_FR_HEAD}))?(?P<m>m)(?P<rest>{_FR_TAIL})?|(?>{_FR_HUNDREDS}|{_FR_HEAD})|[pnijwkK]", _fr_value)

# --- Russian. The words of the language.
_RU_ORDINAL_STEMS = "перв втор трет четверт пят шест седьм восьм девят десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат двадцат тридцат сороков пятидесят шестидесят семидесят восьмидесят девяност сот тысячн".split()
_RU_ORDINAL_ENDINGS = "ый ий ой ое ее ая яя ые ие ого его ому ему ым им ом ем ую юю ей ых их ыми ими ья ье ьи ьего ьему ьем ьей ью ьих ьими".split()
_ru = {s + e: ("o", 0) for s in _RU_ORDINAL_STEMS for e in _RU_ORDINAL_ENDINGS} | _classed(
    z={"ноль": 0, "нуль": 0},
    u=_numbered(1, "один/одна/одно два/две/двух три/трех четыре/четырех пять/пяти шесть/шести семь/семи восемь/восьми девять/девяти"),
    t=_numbered(10, "десять/десяти одиннадцать/одиннадцати двенадцать/двенадцати тринадцать/тринадцати четырнадцать/четырнадцати пятнадцать/пятнадцати шестнадцать/шестнадцати семнадцать/семнадцати восемнадцать/восемнадцати девятнадцать/девятнадцати"),
    d=_numbered(20, "двадцать/двадцати тридцать/тридцати сорок пятьдесят/пятидесяти шестьдесят/шестидесяти семьдесят/семидесяти восемьдесят/восьмидесяти девяносто/девяноста", 10),
    h=_numbered(100, "сто/ста двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот", 100),
    m={"тысяча": 1000},
    M={"тысячи": 1000, "тысяч": 1000},
)
_RU_GROUP = "h(?:t|d?u?)|t|du?|u"


def _ru_one(m: re.Match, values: list[int]) -> int | None:
    if m["next"] is not None and m[0][-1] in "dhmM":
        return None
    part = lambda name: sum(values[m.start(name) : m.end(name)]) if m[name] else 0
    if m["k1"]:
        return 1000 + part("rest1")
    if m["k"]:
        return part("head") * 1000 + part("rest")
    return sum(values[m.start() : m.end()])


RUSSIAN = WordGrammar(_ru, rf"(?:z|(?P<head>(?>{_RU_GROUP}))(?:(?P<k>[mM])(?P<rest>(?>{_RU_GROUP}))?)?|(?P<k1>m)(?P<rest1>(?>{_RU_GROUP}))?)(?P<next>(?=o))?", _ru_one)


# --- Vietnamese and Indonesian: whole runs of number words must fit the grammar.
class RunGrammar:
    """words: word to class letter and digit value. whole: what a run must match. scales: class letters with their size, largest first."""

    def __init__(self, words: dict[str, tuple[str, int]], whole: str, multipliers: str, scales: dict[str, int], small: Callable[[str, list[int]], int], retry: str = ""):
        self.words, self.whole, self.multipliers = words, re.compile(whole), set(multipliers)
        self.scales, self.small, self.retry = scales, small, retry

    def _value(self, classes: str, values: list[int]) -> int | None:
        for letter, size in self.scales.items():
            at = classes.find(letter)
            if at < 0:
                continue
            times = self._value(classes[:at], values[:at]) if at else 1
            rest = self._value(classes[at + 1 :], values[at + 1 :]) if at + 1 < len(classes) else 0
            if times is None or rest is None or rest >= size or (not times and size > 100):
                return None  # only hundreds may be none
            return times * size + rest
        return self.small(classes, values)

    def parse(self, classes: str, values: list[int]) -> int | None:
        if not self.multipliers & set(classes) or not self.whole.fullmatch(classes):
            return None
        n = self._value(classes, values)
        return n if n is not None and n <= LARGEST else None

    def convert(self, text: str) -> str:
        tokens = text.split(" ")
        classes = "".join(self.words.get(t, (".",))[0] for t in tokens)
        values = [self.words[t][1] if t in self.words else 0 for t in tokens]
        out, at = [], 0
        for m in re.finditer(r"[^.]+", classes):
            a, z = m.span()
            out += tokens[at:a]
            n = self.parse(classes[a:z], values[a:z])
            if n is None and self.retry and classes[a] == self.retry and z - a > 1:
                # the first word may belong to what stands before
                n = self.parse(classes[a + 1 : z], values[a + 1 : z])
                if n is not None:
                    out.append(tokens[a])
            out += tokens[a:z] if n is None else [str(n)]
            at = z
        return " ".join(out + tokens[at:])


# The words of the language. Classes 1 to 9 are digits; A, B, C their forms after tens; K zero as a coefficient.
_vi = {nfkc(w).casefold(): c for w, c in {
    "một": ("1", 1), "hai": ("2", 2), "ba": ("3", 3), "bốn": ("4", 4), "năm": ("5", 5), "sáu": ("6", 6), "bảy": ("7", 7), "tám": ("8", 8), "chín": ("9", 9),
    "mốt": ("A", 1), "tư": ("B", 4), "lăm": ("C", 5), "không": ("K", 0), "linh": ("l", 0), "lẻ": ("l", 0),
    "mười": ("x", 10), "mươi": ("y", 10), "trăm": ("t", 100), "nghìn": ("n", 1000), "ngàn": ("n", 1000), "vạn": ("v", 10000),
}.items()}
_VI_TENS = r"(?:x[1-46-9BC]?|[2-9]y[A2-46-9BC]?)"
_VI_ODD = r"l[1-9BC]"
_VI_H = rf"(?:(?:K|{_VI_TENS}|[1-9])t(?:{_VI_ODD}|{_VI_TENS})?)"
_VI_N = rf"(?:(?:{_VI_H}|{_VI_TENS}|[1-9])n(?:{_VI_ODD}|{_VI_H}|{_VI_TENS})?)"
_VI_V = rf"(?:(?:{_VI_N}|{_VI_H}|{_VI_TENS}|[1-9])v(?:{_VI_ODD}|{_VI_N}|{_VI_H}|{_VI_TENS})?)"


def _vi_small(classes: str, values: list[int]) -> int:
    if "y" in classes:
        return values[0] * 10 + sum(values[2:])
    return sum(values)


VIETNAMESE = RunGrammar(_vi, rf"{_VI_V}|{_VI_N}|{_VI_H}|{_VI_TENS}", "vntxy", {"v": 10000, "n": 1000, "t": 100}, _vi_small, "5")

_id = {w: (str(i + 1), i + 1) for i, w in enumerate("satu dua tiga empat lima enam tujuh delapan sembilan".split())} | {
    "sepuluh": ("S", 10), "sebelas": ("E", 11), "puluh": ("p", 10), "belas": ("b", 10), "ratus": ("h", 100), "seratus": ("H", 100), "ribu": ("r", 1000), "seribu": ("R", 1000),
}
_ID_TENS = r"(?:S|E|[2-9]b|[2-9]p[1-9]?|[1-9])"
_ID_H = rf"(?:(?:H|{_ID_TENS}h){_ID_TENS}?|{_ID_TENS})"


def _id_small(classes: str, values: list[int]) -> int:
    if "p" in classes:
        return values[0] * 10 + sum(values[2:])
    return sum(values)


INDONESIAN = RunGrammar(_id, rf"(?:R|{_ID_H}r){_ID_H}?|{_ID_H}", "SEpbhHrR", {"R": 1000, "r": 1000, "H": 100, "h": 100}, _id_small)

# --- German writes numbers as one word. The words of the language.
_DE_UNITS = _numbered(0, "null eins zwei drei vier fünf sechs sieben acht neun") | {"ein": 1}
_DE_TEENS = _numbered(10, "zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn")
_DE_TENS = _numbered(20, "zwanzig dreissig vierzig fünfzig sechzig siebzig achtzig neunzig", 10)
_DE_ORDINALS = _numbered(1, "erst zweit dritt viert fünft sechst siebt/siebent acht neunt zehnt elft zwölft dreizehnt vierzehnt fünfzehnt sechzehnt siebzehnt achtzehnt neunzehnt")
_DE_KEPT = {"ein", "achte", "achten"}
_any_of = lambda words: "|".join(sorted(words, key=len, reverse=True))
_DE_99 = rf"(?:(?:(?:{_any_of(_DE_UNITS)})und)?(?:{_any_of(_DE_TENS)})|{_any_of(_DE_TEENS)}|{_any_of(_DE_UNITS)})"
_DE_9999 = rf"(?:(?:{_DE_99})?hundert(?:und)?(?:{_DE_99})?|{_DE_99})"
_DE_CARDINAL = re.compile(rf"(?:(?P<head>{_DE_9999})?(?P<k>tausend)(?:und)?)?(?P<rest>{_DE_9999})?")
_DE_HUNDRED = re.compile(rf"(?:(?P<head>{_DE_99})?(?P<h>hundert)(?:und)?)?(?P<rest>{_DE_99})?")
_DE_PAIR = re.compile(rf"(?:(?P<u>{_any_of(_DE_UNITS)})und)?(?P<t>{_any_of(_DE_TENS)})")
_DE_ENDINGS = ("en", "er", "es", "em", "e")


def _de_99(word: str) -> int:
    if m := _DE_PAIR.fullmatch(word):
        return _DE_UNITS.get(m["u"], 0) + _DE_TENS[m["t"]]
    return _DE_TEENS[word] if word in _DE_TEENS else _DE_UNITS[word]


def _de_9999(word: str) -> int | None:
    m = _DE_HUNDRED.fullmatch(word)
    times = (_de_99(m["head"]) if m["head"] else 1) if m["h"] else 0
    if m["h"] and not times:
        return None
    return times * 100 + (_de_99(m["rest"]) if m["rest"] else 0)


def german_cardinal(word: str) -> int | None:
    m = _DE_CARDINAL.fullmatch(word) if word else None
    if m is None:
        return None
    head = (_de_9999(m["head"]) if m["head"] else 1) if m["k"] else 0
    rest = _de_9999(m["rest"]) if m["rest"] else 0
    if head is None or rest is None or (m["k"] and rest >= 1000):
        return None
    return n if (n := head * 1000 + rest) <= LARGEST else None


def german_ordinal(word: str) -> int | None:
    for ending in _DE_ENDINGS:
        if not word.endswith(ending):
            continue
        stem = word.removesuffix(ending)
        if stem in _DE_ORDINALS:
            return _DE_ORDINALS[stem]
        if stem.endswith("st") and (n := german_cardinal(stem[:-2])) is not None:
            return n
        for small, n in _DE_ORDINALS.items():
            head = stem.removesuffix(small)
            if head != stem and head.endswith(("hundert", "tausend")) and (big := german_cardinal(head)) is not None:
                return big + n
    return None


@functools.lru_cache(maxsize=100_000)
def _german_word(word: str) -> str:
    if word in _DE_KEPT:
        return word
    n = german_cardinal(word)
    n = german_ordinal(word) if n is None else n
    return word if n is None else str(n)


def german(text: str) -> str:
    return " ".join(map(_german_word, text.split(" ")))
