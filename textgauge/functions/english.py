"""English: spelled numbers, contractions and fillers, by rules written for this engine.

The published recogniser's described behaviour is followed (fillers out, contractions written out, spelled cardinals and
ordinals to digits, ordinals and plurals keep their endings until the ordinal ending is stripped). Fillers, contractions and titles are
those that its normalizer (MIT licence) publishes; its table of spellings is not at hand: a small declared list maps British to American ones, and
the table can be given (`use_spellings`).
"""

from __future__ import annotations

import json
import re
from fractions import Fraction

from textgauge.functions.text import fold_basic

_UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100} | {w: 1000**i for i, w in enumerate("thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split(), 1)}
_ZEROS = {"zero", "oh", "o"}
_COINS = {"dollar", "dollars", "pound", "pounds", "euro", "euros", "cent", "cents"}
_SIGNS = {"minus", "negative", "plus", "positive"}
_TIMES = {"double": 2, "triple": 3}
_IRREGULAR = {"first": "one", "second": "two", "third": "three", "fifth": "five", "eighth": "eight", "ninth": "nine", "twelfth": "twelve"}
# fillers, contractions and titles as published: fixed values
_FILLERS = {"hmm", "mm", "mhm", "mmm", "uh", "um"}
_WHOLE = {"won't": "will not", "can't": "can not", "let's": "let us", "ain't": "aint", "y'all": "you all", "wanna": "want to", "gotta": "got to", "gonna": "going to", "i'ma": "i am going to", "imma": "i am going to", "woulda": "would have", "coulda": "could have", "shoulda": "should have", "ma'am": "madam"}
_ENDINGS = (("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'ve", " have"), ("'m", " am"), ("'t", " not"))
_TITLES = {"mr": "mister", "mrs": "missus", "st": "saint", "dr": "doctor", "prof": "professor", "capt": "captain", "gov": "governor", "gen": "general", "sen": "senator", "rep": "representative", "pres": "president", "rev": "reverend", "hon": "honorable", "asst": "assistant", "assoc": "associate", "lt": "lieutenant", "col": "colonel", "jr": "junior", "sr": "senior", "esq": "esquire"}
#: British spellings and their American ones; a small list, not the published one.
SPELLINGS = {"colour": "color", "colours": "colors", "favour": "favor", "favourite": "favorite", "honour": "honor", "labour": "labor", "neighbour": "neighbor", "behaviour": "behavior", "centre": "center", "centres": "centers", "metre": "meter", "metres": "meters", "theatre": "theater", "grey": "gray", "organise": "organize", "organised": "organized", "realise": "realize", "realised": "realized", "recognise": "recognize", "recognised": "recognized", "analyse": "analyze", "analysed": "analyzed", "travelling": "traveling", "travelled": "traveled", "defence": "defense", "licence": "license", "programme": "program", "programmes": "programs", "catalogue": "catalog", "aluminium": "aluminum", "tyre": "tire", "tyres": "tires"}

#: The spellings in use: those above, or what `read_spellings` gives of the published table where it is at hand.
spellings: dict[str, str] = SPELLINGS


def read_spellings(path: str) -> dict[str, str]:
    """British spellings and their American ones from a JSON object, the form in which the published table comes."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def use_spellings(table: dict[str, str]) -> None:
    global spellings
    spellings = table


def _ordinal(word: str) -> tuple[str, str] | None:
    """The cardinal behind a spelled ordinal, and the ending its digits take."""
    ending = {"first": "st", "second": "nd", "third": "rd"}
    if word == "zeroth":
        return "zero", "th"
    if word in _IRREGULAR:
        return _IRREGULAR[word], ending.get(word, "th")
    if word.endswith("ieth") and word[:-4] + "y" in _TENS:
        return word[:-4] + "y", "th"
    if word.endswith("th") and (word[:-2] in _UNITS or word[:-2] in _SCALES):
        return word[:-2], "th"
    return None


def _plural(word: str) -> tuple[str, str] | None:
    if word.endswith("ies") and word[:-3] + "y" in _TENS:
        return word[:-3] + "y", "s"
    if word.endswith("s") and (word[:-1] in _UNITS and word not in ("ones",) or word[:-1] in _SCALES):
        return word[:-1], "s"
    return None


_COUNTED = [*_UNITS, *_TENS, *_SCALES, *_ZEROS]
#: Every word that can begin a spelled number, for a quick look before any rule runs.
_STARTS = {*_COUNTED, *_IRREGULAR, "zeroth", "point", *_SIGNS, *_TIMES, *(w + "th" for w in _COUNTED), *(w[:-1] + "ieth" for w in _TENS), *(w + "s" for w in _COUNTED), *(w[:-1] + "ies" for w in _TENS)}
_ARABIC = re.compile(r"\d+(?:\.\d+)?", re.ASCII)


class _Number:
    """A number that grows word by word.

    It is a string of digits with `room`: the power of ten below which its last digits are zeros that
    a smaller word may still fill. A word that finds room is added ("twenty" "five", "two thousand"
    "nineteen"); one that finds none stands behind, as years and digits are read out ("nineteen"
    "eighty" "four", "five" "five" "five"). After a decimal point all stand behind.
    """

    def __init__(self):
        self.digits, self.room, self.arabic = "", 0, False

    def __bool__(self) -> bool:
        return bool(self.digits)

    def behind(self, digits: str) -> None:
        self.digits, self.room, self.arabic = self.digits + digits, 1, False

    def small(self, n: int) -> bool:
        """A unit, a teen or a ten; False where digits that were written as such have no room for it."""
        need = 10 if n < 10 else 100
        if self.room >= need:
            self.digits = str(int(self.digits) + n).zfill(len(self.digits)) if "." not in self.digits else self.digits[:-1] + str(n)
        elif self.arabic:
            return False
        else:
            self.digits += str(n)
        self.room, self.arabic = (10 if n >= 20 else 1), False
        return True

    def scale(self, size: int) -> bool:
        """Multiplies what was said since the last thousand; False where that is no whole number."""
        if not self.digits:
            self.digits = str(size)
        elif "." in self.digits:
            whole = Fraction(self.digits.rstrip(".")) * size
            if whole.denominator != 1:
                return False
            self.digits = str(whole)
        else:
            thousands, rest = divmod(int(self.digits), 1000) if self.room > 1 or len(self.digits) > 4 or size == 100 else (0, int(self.digits))
            self.digits = str(thousands * 1000 + rest * size)
        zeros = len(self.digits) - len(self.digits.rstrip("0"))
        self.room, self.arabic = 10**zeros, False
        return True


def _kind(word: str) -> tuple[str, str, str]:
    """What a word is (zero, small, scale or nothing), the cardinal it stands for and the ending its digits take."""
    plain, ending = word, ""
    if word not in _UNITS and word not in _TENS and word not in _SCALES and word not in _ZEROS:
        plain, ending = _ordinal(word) or _plural(word) or ("", "")
    if plain in _ZEROS:
        return "zero", plain, ending
    if plain in _UNITS or plain in _TENS:
        return "small", plain, ending
    return ("scale", plain, ending) if plain in _SCALES else ("", "", "")


def _spoken(word: str) -> bool:
    return bool(_kind(word)[0]) or word in _TIMES or word == "point" or _ARABIC.fullmatch(word) is not None


def spelled_numbers(text: str) -> str:
    """Spelled cardinals and ordinals to digits; ordinals and plurals keep an ending ("20th", "1960s").

    Numbers that are read out digit by digit or by pairs are joined, "double" and "triple" repeat a
    digit, "point" begins decimals, "and a half" is point five. A currency or per cent behind a number
    and a sign before one go, as their symbols would.
    """
    if _STARTS.isdisjoint(text.replace("\n", " ").split(" ")) and not _DIGIT.search(text):
        return text
    text = re.sub(r"([a-z])([0-9])", r"\1 \2", text)
    text = re.sub(r"([0-9])([a-z])", r"\1 \2", text)
    # an ending belongs to the digits before it, also where a mark stood between them
    text = re.sub(r"([0-9])\s+(st|nd|rd|th|s)\b", r"\1\2", text)
    text = re.sub(rf"\b({'|'.join([*_UNITS, *_TENS, *_SCALES, *_ZEROS])}) and a half\b", r"\1 point five", text)
    out, words, at = [], text.split(" "), 0
    number = _Number()

    def flush(ending: str = "") -> None:
        nonlocal number
        if number:
            out.append(number.digits.rstrip(".") + ending)
        number = _Number()

    while at < len(words):
        word, before, after = words[at], words[at - 1] if at else "", words[at + 1] if at + 1 < len(words) else ""
        kind, plain, ending = _kind(word)
        at += 1
        if _ARABIC.fullmatch(word):
            if number.digits.endswith("."):
                number.behind(word)
                continue
            flush()
            number.digits, number.arabic = word, True
            number.room = 10 ** (len(word) - len(word.rstrip("0"))) if "." not in word else 1
        elif kind == "zero":
            if number.arabic:
                flush()
            number.behind("0")
        elif kind == "small":
            n = _UNITS.get(plain, _TENS.get(plain))
            if not number.small(n):
                flush()
                number.small(n)
        elif kind == "scale":
            if not number.scale(_SCALES[plain]):
                flush()
                number.scale(_SCALES[plain])
        elif word == "point" and (_kind(after)[0] in ("zero", "small") or _ARABIC.fullmatch(after)) and "." not in number.digits:
            number.behind(".")
        elif word in _TIMES and _kind(after)[0] in ("zero", "small") and after not in _TENS:
            number.behind(str(_UNITS.get(after, 0)) * _TIMES[word])
            at += 1
        elif word == "and" and number and before in _SCALES and _spoken(after):
            continue
        elif word in _SIGNS and _spoken(after):
            flush()
        elif number and (word in _COINS or word == "percent"):
            flush()
        elif number and word == "per" and after == "cent":
            flush()
            at += 1
        else:
            flush()
            out.append(word)
            continue
        if ending:
            flush(ending)
    flush()
    return " ".join(out)


_DIGIT = re.compile("[0-9]")


def lone_ones(text: str) -> str:
    """A one that stands alone is written as a word, however it was given."""
    return re.sub(r"\b1(s?)\b", r"one\1", text, flags=re.ASCII)


def written_out(text: str) -> str:
    """Fillers out; contractions, titles and spellings as the tables say."""
    out = []
    for word in text.split(" "):
        if word in _FILLERS:
            continue
        if word in _WHOLE:
            word = _WHOLE[word]
        elif "'" in word:
            for ending, full in _ENDINGS:
                if word.endswith(ending) and word != ending:
                    word = word.removesuffix(ending) + full
                    break
        out.append(_TITLES.get(word, spellings.get(word, word)))
    return " ".join(out)


def english_layer(text: str) -> str:
    text = written_out(text)
    text = re.sub(r"\s+'", "'", text)
    return fold_basic(spelled_numbers(text))
