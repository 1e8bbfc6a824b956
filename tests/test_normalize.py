import random

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textgauge.functions import charnumbers, english, normalize, plain, wordnumbers
from textgauge.functions import text as t
from textgauge.plans import catalog
from textgauge.plans.goldens import GOLDENS, RULES

CASES = [(lang, *row) for lang, rows in GOLDENS.items() for row in rows]


@pytest.mark.parametrize("lang,strip,text,expected", CASES)
def test_published_expectations(lang, strip, text, expected):
    assert normalize.normalize(lang, text, strip) == expected


@pytest.mark.parametrize("lang", normalize.LANGUAGES)
def test_empty_and_blank(lang):
    assert normalize.normalize(lang, "") == "" == normalize.normalize(lang, "  \t ")


@pytest.mark.parametrize("lang,strip,text,expected", [c for c in CASES if not c[1]])
def test_idempotent_on_cases(lang, strip, text, expected):
    assert normalize.normalize(lang, expected) == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 99))
def test_german_compounds_read_back(n):
    units = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
    tens = "- - zwanzig dreissig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
    word = units[n] if n < 20 else tens[n // 10] if n % 10 == 0 else ("ein" if n % 10 == 1 else units[n % 10]) + "und" + tens[n // 10]
    assert wordnumbers.german_cardinal(word) == n
    assert wordnumbers.german_cardinal(f"{word}tausend") == n * 1000


def _spanish(n):
    small = {v: k for k, (c, v) in reversed(wordnumbers._es.items()) if c in "zut"}
    tens = {v: k for k, (c, v) in wordnumbers._es.items() if c == "d"}
    hundreds = {v: k for k, (c, v) in reversed(wordnumbers._es.items()) if c == "h"}
    if n >= 1000:
        return ("" if n < 2000 else _spanish(n // 1000) + " ") + "mil" + (" " + _spanish(n % 1000) if n % 1000 else "")
    if n == 100:
        return "cien"
    if n > 100:
        return hundreds[n // 100 * 100] + (" " + _spanish(n % 100) if n % 100 else "")
    if n < 30:
        return small[n]
    return tens[n // 10 * 10] + (" y " + small[n % 10] if n % 10 else "")


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 99_999))
def test_spanish_numbers_read_back(n):
    assert wordnumbers.SPANISH.convert(_spanish(n)) == str(n)


def _kanji(n):
    out = ""
    if n >= 10_000:
        out, n = _kanji(n // 10_000) + "万", n % 10_000
    for unit, size in (("千", 1000), ("百", 100), ("十", 10)):
        if n >= size:
            out, n = out + ("" if n // size == 1 else "〇一二三四五六七八九"[n // size]) + unit, n % size
    return out + ("〇一二三四五六七八九"[n] if n else "")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 99_999))
def test_japanese_numbers_read_back(n):
    text = _kanji(n)
    bare = set(text) <= set("十百千万") or text == "万一"
    assert charnumbers.japanese(text) == (text if bare else str(n))


def test_english_numbers():
    for text, expected in (("one hundred and twenty three", "123"), ("two thousand five", "2005"), ("nineteen eighty four", "1984"), ("five million", "5000000"), ("black and white", "black and white"), ("one two", "12"),
        ("nineteen ninety nine", "1999"), ("twenty twenty", "2020"), ("twenty oh five", "2005"), ("oh one", "01"), ("double five", "55"), ("triple zero seven", "0007"), ("three point one four", "3.14"), ("two and a half", "2.5"),
        ("three point five million", "3500000"), ("two point five thousand", "2500"), ("twenty one dollars", "21"), ("five percent", "5"), ("seventy per cent", "70"), ("minus five", "5"), ("a hundred", "a 100"), ("twenty first", "21st"), ("nineteen sixties", "1960s"),
        ("one million two hundred thousand three", "1200003"), ("fifteen hundred", "1500"), ("two hundred and five", "205"), ("the point is", "the point is"), ("plus size", "plus size"), ("20 five", "25"), ("3 one", "3 1"), ("two hundredth", "200th"), ("six hundred thousand", "600000")):
        assert english.spelled_numbers(text) == expected


def test_english_sentences():
    for text, expected in (("It cost twenty-one dollars, five percent more.", "it cost 21 5 more"), ("chapter 1", "chapter one"), ("3.5 million", "3 5000000"), ("5km", "5 km"), ("the 1960s", "the 1960s"), ("In nineteen ninety-nine", "in 1999")):
        assert normalize.normalize("en", text) == expected
        assert normalize.normalize("en", expected) == expected


def test_traditional_characters_by_the_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("兩萬三千",), ("三萬三千",), ("這是繁體中文",), ("这是简体",)], "t string")
    got = [r[0] for r in rows.select(normalize.normalized(F.lit("zh"), F.col("t"))).collect()]
    assert got == ["23000", "33000", "这是繁体中文", "这是简体"]


def test_words_are_cut_from_the_normal_form(monkeypatch):
    seen = []
    monkeypatch.setattr(normalize, "_word_cutter", lambda lang: lambda text: seen.append(text) or text.split("、"))
    assert normalize.tokenize("ja", "ＡＢＣ　二十一") == [normalize.normalize("ja", "ＡＢＣ　二十一")] == seen
    assert normalize.forms("de", "Zwei Häuser", False) == {"chars": "2 häuser", "words": ["2 häuser"]}
    with pytest.raises(ValueError):
        normalize.forms("xx", "a", False)


def test_contractions_and_fillers():
    assert normalize.normalize("en", "Um, I can’t, won't") == "i can not will not"
    assert normalize.normalize("en", "colour") == normalize.normalize("en", "color")


def test_kept_marks():
    assert t.blank_marks_but("don’t 'quote' a'b'c 1.5. x.y") == "don't  quote  a'b'c 1 5  x y"
    assert t.blank_marks_but("'a' 1.5.2.", point=True) == " a  1.5.2 "
    assert t.blank_marks_but("a'b 1.5", apostrophe=False, point=True) == "a b 1.5"
    assert t.blank_marks_but("\ue000\ue001") == "\ue000\ue001"  # private characters are no marks
    assert t.fold_basic("Don't  e\u0301 1.5%") == "don't é 1.5"


def test_long_vowel_marks():
    assert t.long_vowels("サ―バ‐‐") == "サーバーー"
    assert t.long_vowels("a-b") == "a-b"


def test_closed_up_offsets():
    assert t.close_up("a bc d") == ("abcd", frozenset({1, 3}))


def test_tokenizers():
    assert normalize.tokenize("en", "Hello, World!") == ["hello", "world"]
    assert normalize.tokenize("ru", " ") == []
    with pytest.raises(normalize.Unavailable):
        normalize.tokenize("th", "x")


def test_columns(spark):
    from pyspark.sql import functions as F

    normalize.register(spark)
    rows = spark.createDataFrame([("de", "Einundzwanzig!"), ("xx", "a"), ("de", None)], "lang string, text string")
    got = [r[0] for r in rows.select(normalize.normalized(F.col("lang"), F.col("text"))).collect()]
    assert got == ["21", None, None]
    assert spark.sql("SELECT tg_normalize('es', 'setenta y ocho', false)").first()[0] == "78"
    assert spark.sql("SELECT tg_tokenize('es', 'Hola, dos')").first()[0] == ["hola", "2"]
    assert spark.sql("SELECT tg_edit_ops('abc', 'axc')").first()[0]["sub"] == 1


def test_single_rules(spark):
    rows = spark.createDataFrame([r[:2] for r in RULES], "rule string, t string")
    for name, rule in catalog._RULES.items():
        got = {r.t: r.made for r in rows.where(f"rule = '{name}'").select("t", rule(F.col("t")).alias("made")).collect()}
        assert got == {t: want for n, t, want in RULES if n == name} and got


_CHARACTERS = "abz ABZ éÉàßÇøÿ\t\n\x0b\x0c\r\x1c\u00a0.,;:!?-_'’\"()[]{}|`~^$+<=>@#%&*/\\\\«»“”„–—…¿¡0123456789×÷ªº½µıİſﬁ\u0301"
_WORDS = "one the and point ein eine einen einst eins einundzwanzig achte achtung zwei erste hundert und un une et deux vingts vingt uno y mil ciento de um e dois gray grey mr can't won't o' uh o 1st 20 première premier segundo décimo quarto straße ok".split()


@pytest.mark.parametrize("lang", ["en", "de", "es", "fr", "pt", "ru"])
def test_plain_forms_are_those_of_the_rules(lang):
    """Whatever the table of bytes claims is what the rules say: random texts of odd characters and of words that rules are about."""
    rng = random.Random(lang)
    texts = ["".join(rng.choice(_CHARACTERS) for _ in range(rng.randint(0, 12))) for _ in range(15_000)]
    texts += ["".join(rng.choice(_WORDS) + rng.choice([" ", " ", " ", ", ", "\n", "-", ""]) for _ in range(rng.randint(1, 6))) for _ in range(15_000)]
    texts += [chr(c) * k + " x" for c in range(0x3000) for k in (1, 3)] + [f"Le mot {w} reste" for w in _WORDS] + ["", " ", "plain words of any kind"]
    grammar = {"es": wordnumbers.SPANISH, "fr": wordnumbers.FRENCH, "pt": wordnumbers.PORTUGUESE}.get(lang)
    if grammar:
        texts += [" ".join(rng.choice(list(grammar.words)) for _ in range(rng.randint(1, 4))) for _ in range(15_000)]
        assert not plain.starting_words(lang) & {w.encode() for w in {"es": ["y", "un"], "fr": ["et", "un"], "pt": ["e", "um"]}[lang]}
    if lang == "de":
        texts += ["".join(rng.choice([*wordnumbers._DE_UNITS, *wordnumbers._DE_TENS, *wordnumbers._DE_ORDINALS, "und", "hundert", "tausend", "st", "e", "en", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(15_000)]
    claimed = [(x, form) for x in texts if (form := plain.plain_form(lang, x)) is not None]
    wrong = [(x, form, normalize.NORMALIZERS[lang](x)) for x, form in claimed if form != normalize.NORMALIZERS[lang](x)]
    assert not wrong, wrong[:5]
    assert (len(claimed) > 1000) == (lang != "ru")


@pytest.mark.parametrize("sf", [SMALL])
def test_plain_forms_of_whole_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").where("text is not null and lang is not null").collect()
    claimed = [(r, form) for r in rows if (form := plain.plain_form(r.lang, r.text)) is not None]
    assert len(claimed) > 0.7 * len(rows) and all(form == normalize.NORMALIZERS[r.lang](r.text) for r, form in claimed)


def test_spellings_can_be_given(spark, tmp_path):
    (tmp_path / "english.json").write_text('{"jewellery": "jewelry", "grey": "gray", "odde": "one"}')
    rows = spark.createDataFrame([("Grey jewellery, colour!",), ("it's grey jewellery 5",), ("odde thing",)], "t string").select(F.col("t"), F.lit("en").alias("lang"))
    read = lambda: [r.n for r in rows.select(normalize.normalized(F.col("lang"), F.col("t")).alias("n")).collect()]
    assert read() == ["gray jewellery color", "it is gray jewellery 5", "odde thing"]
    try:
        english.use_spellings(english.read_spellings(str(tmp_path / "english.json")))
        assert read() == ["gray jewelry colour", "it is gray jewelry 5", normalize.NORMALIZERS["en"]("odde thing")] and normalize.normalize("en", "colour") == "colour"
    finally:
        english.use_spellings(english.SPELLINGS)
    assert read() == ["gray jewellery color", "it is gray jewellery 5", "odde thing"]


ENDINGS = [("Version 3. th of", "version 3 of"), ("No. 247 29-St. that", "no 247 29 that"), ("73.104-nd was", "73 104 was"), ("on 1 s and 5 s", "on ones and 5s"), ("20th 1960s 3rdly", "20 1960s 3 rdly")]


@pytest.mark.parametrize("text,expected", ENDINGS)
def test_english_endings_behind_marks_belong_to_their_digits(text, expected):
    import duckdb

    from textgauge.plans.twins import english_sql

    assert normalize.normalize("en", text) == expected
    assert duckdb.execute(f"SELECT {english_sql('t')} FROM (SELECT ? AS t)", [text]).fetchone()[0] == expected


def test_words_are_counted_after_endings_join_their_digits():
    assert [len(normalize.tokenize("en", text)) for text, _ in ENDINGS] == [len(expected.split(" ")) for _, expected in ENDINGS]


def test_orders_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(catalog, "ORDERS_EACH", 100)
    assert catalog.QUERIES["normalize_pt"](spark, SMALL).rdd.getNumPartitions() >= 15


def test_repeated_texts_are_normalized_once(monkeypatch):
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(normalize, "normalize", lambda lang, text, strip=False: asked.append((lang, text, strip)) or text.upper())
    rows = [("th", "a", True), ("th", "a", False), ("fr", "a", True), ("fr", "a", False), ("fr", "b" * 129, False)] * 2
    columns = tuple(pa.array(c) for c in zip(*rows, strict=True))
    out = [x for part in normalize._normalized(iter([columns, columns]), "these settings") for x in part.to_pylist()]
    assert out == [text.upper() for _, text, _ in rows * 2]
    assert sorted(x for x in asked if len(x[1]) == 1) == [("fr", "a", False), ("th", "a", False), ("th", "a", True)] and len(asked) == 7


def test_remembered_forms_belong_to_their_settings(monkeypatch):
    monkeypatch.setattr(normalize, "simplify", lambda text: text.replace("頁", "1"))
    assert normalize._known("one", "zh", "頁", False) == "1"
    monkeypatch.setattr(normalize, "simplify", lambda text: text.replace("頁", "2"))
    assert normalize._known("two", "zh", "頁", False) == "2" and normalize._known("two", "fr", "la page dix", True) == "la page 10"
