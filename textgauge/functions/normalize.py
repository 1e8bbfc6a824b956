"""Normalizers and tokenizers of the twelve languages, and their registration with Spark."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textgauge.functions import charnumbers, english, wordnumbers
from textgauge.functions import text as t
from textgauge.functions.plain import plain_form
from textgauge.functions.tries import Converter, Dictionary, converter

LANGUAGES = ("de", "en", "es", "fr", "id", "ja", "ko", "pt", "ru", "th", "vi", "zh")
#: Languages scored by characters, whose normalizers can drop all white space first.
BY_CHARACTER = ("ja", "th", "zh")


def _folded(text: str) -> str:
    return t.nfkc(text).casefold().replace("’", "'")


def _with_basic_layer(text: str) -> str:
    return t.one_space(t.blank_marks_but(t.fold_basic(text), point=True))


def normalize_en(text: str) -> str:
    text = t.one_space(t.blank_marks_but(t.join_comma_groups(_folded(text))))
    text = t.bare_ordinals(english.english_layer(t.one_space(english.spelled_numbers(text))), "st|nd|rd|th")
    return english.lone_ones(t.one_space(t.blank_marks_but(text)))


def normalize_de(text: str) -> str:
    text = t.join_groups(t.comma_to_point(t.join_groups(_folded(text), "'")), r"\.")
    text = wordnumbers.german(t.one_space(t.blank_marks_but(text, point=True)))
    return _with_basic_layer(t.one_space(text))


def _iberian(grammar: wordnumbers.WordGrammar, text: str) -> str:
    text = t.join_groups(t.comma_to_point(_folded(text)), r"\.")
    text = grammar.convert(t.one_space(t.blank_marks_but(text, point=True)))
    return _with_basic_layer(t.one_space(t.bare_ordinals(text, "[oa]s?")))


def normalize_es(text: str) -> str:
    return _iberian(wordnumbers.SPANISH, text)


def normalize_pt(text: str) -> str:
    return _iberian(wordnumbers.PORTUGUESE, text)


def normalize_fr(text: str) -> str:
    spaces = "[   ]"
    text = t.join_groups(t.comma_to_point(_folded(text)), spaces)
    text = wordnumbers.FRENCH.convert(t.one_space(t.blank_marks_but(text, point=True)))
    text = t.one_space(t.bare_ordinals(text, "ères?|eres?|ers?|res?|èmes?|emes?|e"))
    return t.join_groups(_with_basic_layer(t.join_groups(text, spaces)), spaces)


def normalize_ru(text: str) -> str:
    text = t.nfkc(t.join_groups(text, "[  ]")).casefold().replace("ё", "е")
    return wordnumbers.RUSSIAN.convert(t.one_space(t.blank_marks(text)))


def _apostrophes_kept(grammar: wordnumbers.RunGrammar, text: str) -> str:
    text = t.join_groups(t.nfkc(text).casefold(), r"\.")
    return grammar.convert(t.one_space(t.blank_marks_but(text)))


def normalize_vi(text: str) -> str:
    return _apostrophes_kept(wordnumbers.VIETNAMESE, text)


def normalize_id(text: str) -> str:
    return _apostrophes_kept(wordnumbers.INDONESIAN, text)


def normalize_ko(text: str) -> str:
    return charnumbers.korean(t.one_space(t.blank_marks(t.join_comma_groups(t.nfkc(text).casefold()))))


def _cleaned(text: str) -> str:
    return t.one_space(t.blank_marks(t.join_ascii_comma_groups(text)))


def normalize_ja(text: str, strip: bool = False) -> str:
    text = _cleaned(t.long_vowels(t.nfkc(text).lower()))
    return charnumbers.japanese(*t.close_up(text)) if strip else charnumbers.japanese(text)


#: Traditional to simplified characters: any function of a text that is set here (such as tries.converter of the published files), or OpenCC's
#: t2s where it is installed, or the phrases and frequent characters of `tries` over the characters that `simplified_table` gives, which the columns below carry to the workers.
simplify: Callable[[str], str] | None = None
#: Dictionaries that cut the normal forms of a language into words, by language (see tries.dictionary); without one the published libraries are looked for.
dictionaries: dict[str, Dictionary] = {}


@functools.cache
def simplified_table() -> dict[str, str]:
    """Traditional characters and their simplified ones, one by one, by the transliterator that comes with Spark; empty where it is not there."""
    spark = SparkSession.getActiveSession()
    try:
        found = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Hant-Hans")
    except Exception:  # noqa: BLE001 - no session, a remote one, or a Spark without that library
        return {}
    han = [chr(c) for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)) for c in range(lo, hi)]
    return {a: b for a, b in zip(han, found.transliterate("\n".join(han)).split("\n"), strict=True) if a != b}


_characters: Converter = converter()


def use(characters: Converter, simple: Callable[[str], str] | None, words: dict[str, Dictionary], spellings: dict[str, str] | None) -> None:
    """What a worker's Chinese normalizer falls back on, and what the driver has set; spellings None: the declared ones."""
    if spellings is not None and spellings != english.spellings:
        english.use_spellings(spellings)
    elif spellings is None:
        english.use_spellings(english.SPELLINGS)
    global _characters, simplify, dictionaries
    _characters, simplify, dictionaries = characters, simple, words


@functools.cache
def _converter() -> Callable[[str], str] | None:
    try:
        import opencc
    except ImportError:
        return None
    return opencc.OpenCC("t2s").convert


def normalize_zh(text: str, strip: bool = False) -> str:
    text = t.nfkc(text)
    text = (simplify or _converter() or _characters)(text)
    text = _cleaned(text.lower())
    return charnumbers.chinese(*t.close_up(text)) if strip else charnumbers.chinese(text)


def normalize_th(text: str, strip: bool = False) -> str:
    text = _cleaned(t.thai_digits(t.nfkc(text)).lower())
    return charnumbers.thai(re.sub(r"\s+", "", text) if strip else text)


NORMALIZERS: dict[str, Callable[..., str]] = {"de": normalize_de, "en": normalize_en, "es": normalize_es, "fr": normalize_fr, "id": normalize_id, "ja": normalize_ja, "ko": normalize_ko, "pt": normalize_pt, "ru": normalize_ru, "th": normalize_th, "vi": normalize_vi, "zh": normalize_zh}


def normalize(lang: str, text: str, strip: bool = False) -> str:
    """The normal form of a text; `strip` drops all white space before numbers are read (ja, th, zh only)."""
    if (form := plain_form(lang, text)) is not None:
        return form
    rule = NORMALIZERS[lang]
    return rule(text, strip) if lang in BY_CHARACTER else rule(text)


#: Characters of a text up to which a worker remembers its normal form, and how many it remembers: some 150 MB.
SHORT, REMEMBERED = 128, 1 << 18


@functools.lru_cache(REMEMBERED)
def _remembered(settings: str, lang: str, text: str, strip: bool) -> str:
    return normalize(lang, text, strip)


_TWO, _THREE = Iterator[tuple[pa.Array, pa.Array]], Iterator[tuple[pa.Array, pa.Array, pa.Array]]


class Unavailable(RuntimeError):
    """A tokenizer that needs a library which is not installed."""


def _word_cutter(lang: str) -> Callable[[str], list[str]]:
    """What cuts a normal form of a language into words."""
    return dictionaries[lang].cut if lang in dictionaries else _library_cutter(lang)


@functools.cache
def _library_cutter(lang: str) -> Callable[[str], list[str]]:
    """Made once in a process."""
    if lang == "th":
        raise Unavailable("Thai is scored by characters only")
    if lang == "ja":
        try:
            import fugashi
        except ImportError as e:
            raise Unavailable("Japanese words need fugashi and unidic-lite, or a dictionary") from e
        tagger = fugashi.Tagger()
        return lambda text: [str(w.surface) for w in tagger(text)]
    if lang == "zh":
        try:
            import jieba
        except ImportError as e:
            raise Unavailable("Chinese words need jieba, or a dictionary") from e
        return lambda text: [w for w in jieba.lcut(text) if w.strip()]
    return lambda text: text.split(" ") if text else []


def tokenize(lang: str, text: str) -> list[str]:
    """Words of the normal form of a text: cut at spaces; by a dictionary, or MeCab for ja and jieba for zh; never for th, which has none."""
    return _word_cutter(lang)(normalize(lang, text))


def characters(text: str) -> list[str]:
    return list(text)


def can_tokenize(lang: str) -> bool:
    if lang == "th":
        return False
    try:
        _word_cutter(lang)
    except Unavailable:
        return False
    return True


def _with_table(f: Callable, hint: type) -> Callable:
    """`f` for a column, with what the driver has for simplified characters and for words set in the worker first; `f` is told a name for these settings."""
    name = uuid.uuid4().hex
    set_here = (converter().over(simplified_table()), simplify, dict(dictionaries), None if english.spellings is english.SPELLINGS else english.spellings)

    def run(batches):
        use(*set_here)
        yield from f(batches, name)

    run.__annotations__ = {"batches": hint, "return": Iterator[pa.Array]}
    return run


def _known(settings: str, lang: str, text: str, strip: bool) -> str:
    """As normalize; short texts, which come again and again, are normalized once as long as a worker remembers them."""
    return _remembered(settings, lang, text, strip and lang in BY_CHARACTER) if len(text) <= SHORT else normalize(lang, text, strip)


def _normalized(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]], settings: str) -> Iterator[pa.Array]:
    for langs, texts, strips in batches:
        rows = zip(langs.to_pylist(), texts.to_pylist(), strips.to_pylist(), strict=True)
        yield pa.array([None if x is None or lang not in NORMALIZERS else _known(settings, lang, x, bool(s)) for lang, x, s in rows], pa.string())


def _tokenized(batches: Iterator[tuple[pa.Array, pa.Array]], settings: str) -> Iterator[pa.Array]:
    for langs, texts in batches:
        yield pa.array([None if x is None or lang not in NORMALIZERS or not can_tokenize(lang) else _word_cutter(lang)(_known(settings, lang, x, False)) for lang, x in zip(langs.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(pa.string()))


def forms(lang: str, text: str, strip: bool, form: Callable[[str, str, bool], str] = normalize) -> dict:
    """chars and words of a text, normalized once where words are cut from the same form; words are None where a language has none to count."""
    if lang not in NORMALIZERS:
        raise ValueError(f"no rules for the language {lang!r}")
    plain = form(lang, text, False)
    chars = form(lang, text, True) if strip and lang in BY_CHARACTER else plain
    return {"chars": chars, "words": _word_cutter(lang)(plain) if can_tokenize(lang) else None}


def _forms(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]], settings: str) -> Iterator[pa.Array]:
    form = functools.partial(_known, settings)
    kind = pa.struct([("chars", pa.string()), ("words", pa.list_(pa.string()))])
    for langs, texts, strips in batches:
        yield pa.array([None if x is None else forms(lang, x, bool(s), form) for lang, x, s in zip(langs.to_pylist(), texts.to_pylist(), strips.to_pylist(), strict=True)], kind)


def normal_forms(lang: Column, text: Column, strip: Column | bool = False) -> Column:
    """struct<chars,words> of a text for scoring; null for a null text. An unknown language stops the query, as its rows would else leave the rate unseen."""
    return arrow_udf(_with_table(_forms, _THREE), "struct<chars:string,words:array<string>>")(lang, text, strip if isinstance(strip, Column) else F.lit(strip))


def normalized(lang: Column, text: Column, strip: Column | bool = False) -> Column:
    """The normal form as a column; null for null texts and unknown languages."""
    return arrow_udf(_with_table(_normalized, _THREE), "string")(lang, text, strip if isinstance(strip, Column) else F.lit(strip))


def tokenized(lang: Column, text: Column) -> Column:
    """Words as a column; null for null texts, unknown languages and languages whose tokenizer is not installed."""
    return arrow_udf(_with_table(_tokenized, _TWO), "array<string>")(lang, text)


def register(spark: SparkSession) -> None:
    """SQL functions: tg_normalize(lang, text, strip), tg_tokenize(lang, text), tg_edit_ops(ref, hyp)."""
    from textgauge.operators.align import _edit_ops

    spark.udf.register("tg_normalize", arrow_udf(_with_table(_normalized, _THREE), "string"))
    spark.udf.register("tg_tokenize", arrow_udf(_with_table(_tokenized, _TWO), "array<string>"))
    spark.udf.register("tg_edit_ops", arrow_udf(_edit_ops, "struct<sub:int,del:int,ins:int,ref_len:int>"))
