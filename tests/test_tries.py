import pickle
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from textgauge.functions import normalize, tries
from textgauge.operators.align import edit_ops
from textgauge.functions.tries import UNKNOWN, UNKNOWN_MORE, Converter, Dictionary, Trie


@pytest.fixture(autouse=True)
def as_before():
    yield
    normalize.simplify, normalize.dictionaries = None, {}


def test_prefixes():
    trie = Trie([("a", 1), ("abc", 2), ("b", 3), ("", 9)])
    assert list(trie.prefixes("abcd", 0)) == [(1, 1), (3, 2)] and list(trie.prefixes("abcd", 1)) == [(2, 3)] and not list(trie.prefixes("abcd", 3))


def test_traditional_characters_without_a_session():
    """The published cases, and phrases that single characters would convert wrongly."""
    assert normalize.NORMALIZERS["zh"]("這是繁體中文") == "这是繁体中文" == normalize.normalize("zh", "这是繁体中文")
    assert normalize.normalize("zh", "兩萬三千") == "23000" and normalize.normalize("zh", "三萬三千") == "33000"
    assert normalize.normalize("zh", "我們一起學習") == normalize.normalize("zh", "我们一起学习")
    make = tries.converter()
    assert make("乾隆乾燥著作看著麵包") == "乾隆干燥著作看着面包" and make("") == "" and make("abc這") == "abc这"
    assert len(tries.COMMON.split()) < 200 and all(len(p) == 2 for p in tries.COMMON.split())


def test_longest_phrase_wins():
    rng = random.Random(1)
    for _ in range(300):
        phrases = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): str(i) for i in range(rng.randint(0, 6))}
        singles = {c: c.upper() for c in rng.sample("abc", rng.randint(0, 3))}
        text, out, at = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 15))), "", 0
        while at < len(text):
            found = max((p for p in phrases if text.startswith(p, at)), key=len, default=None)
            out += phrases[found] if found else singles.get(text[at], text[at])
            at += len(found) if found else 1
        assert Converter(singles, phrases)(text) == out == pickle.loads(pickle.dumps(Converter(singles, phrases)))(text)


def test_tables_from_files(tmp_path, spark):
    (tmp_path / "characters.txt").write_text("# none\n髮\t发 髪\n乾\t干\n")
    (tmp_path / "phrases.txt").write_text("乾隆\t乾隆\n頭髮\t头发\n")
    files = (str(tmp_path / "characters.txt"), str(tmp_path / "phrases.txt"))
    made = tries.converter(*files)
    assert made("乾隆頭髮乾髮") == "乾隆头发干发" and len(pickle.dumps(made)) < 300 and pickle.loads(pickle.dumps(made)) is made
    normalize.simplify = made
    rows = spark.createDataFrame([("頭髮乾",)], "t string").select(normalize.normalized(F.lit("zh"), F.col("t"))).collect()
    assert rows[0][0] == "头发干"


def cheapest(d: Dictionary, text: str) -> float:
    """The least cost over all ways to cut a text and to choose kinds, one after another."""
    least = float("inf")
    for cuts in product((False, True), repeat=max(0, len(text) - 1)):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
        words = [text[a:b] for a, b in zip([0, *ends], ends)]
        choices = []
        for w in words:
            kinds = list(d.entries.get(w, []))
            like = {tries._like(c) for c in w}
            if len(w) == 1 or (len(like) == 1 and len(next(iter(like))) > 1):
                kinds.append((0, 0, UNKNOWN + UNKNOWN_MORE * (len(w) - 1)))
            choices.append(kinds)
        for path in product(*choices):
            rights, lefts = [0, *(r for _, r, _ in path)], [*(left for left, _, _ in path), 0]
            least = min(least, sum(c for *_, c in path) + sum(d.joins.get(x, 0.0) for x in zip(rights, lefts)))
    return least


def cost_of(d: Dictionary, words: list[str]) -> float:
    kinds = [[*d.entries.get(w, []), *([(0, 0, UNKNOWN + UNKNOWN_MORE * (len(w) - 1))] if len({tries._like(c) for c in w}) == 1 else [])] for w in words]
    return min(sum(c for *_, c in path) + sum(d.joins.get(x, 0.0) for x in zip([0, *(r for _, r, _ in path)], [*(left for left, _, _ in path), 0])) for path in product(*kinds))


def test_words_are_the_cheapest_of_all_segmentations():
    rng = random.Random(2)
    for _ in range(150):
        entries = {}
        for _ in range(rng.randint(0, 10)):
            entries.setdefault("".join(rng.choice("天地人a1") for _ in range(rng.randint(1, 3))), []).append((rng.randint(0, 2), rng.randint(0, 2), float(rng.randint(0, 30_000))))
        d = Dictionary(entries, {(a, b): float(rng.randint(-3000, 3000)) for a in range(3) for b in range(3) if rng.random() < 0.6})
        text = "".join(rng.choice("天地人a1") for _ in range(rng.randint(1, 7)))
        words = d.cut(text)
        assert "".join(words) == text and cost_of(d, words) == pytest.approx(cheapest(d, text))
    assert Dictionary({}).cut("") == [] == Dictionary({}).cut(" \n") and Dictionary({}).cut("天地 ab12") == ["天", "地", "ab", "12"]


def test_japanese_and_chinese_get_words_where_there_is_a_dictionary(spark, tmp_path):
    (tmp_path / "ja.csv").write_text("すもも,1,1,3000,noun\nも,2,2,1000,particle\nもも,1,1,3000,noun\nの,2,2,1000,particle\nうち,1,1,3000,noun\nすも,1,1,9000,noun\n")
    (tmp_path / "matrix.def").write_text("3 3\n1 1 5000\n1 2 -500\n2 1 -500\n2 2 4000\n")
    (tmp_path / "zh.txt").write_text("北京 50 ns\n大学 40 n\n北京大学 30 nt\n生 20 v\n大学生 25 n\n前来 10 v\n应聘 9 v\n")
    rows = spark.createDataFrame([("ja", "すもももももももものうち"), ("zh", "北京大學生前来应聘"), ("th", "ห้า"), ("en", "two words"), ("ja", None)], "lang string, t string")
    cut = lambda: [r.w for r in rows.select(normalize.tokenized(F.col("lang"), F.col("t")).alias("w")).collect()]
    if not normalize.can_tokenize("ja"):
        assert cut() == [None, None, None, ["2", "words"], None]
    normalize.dictionaries = {"ja": tries.dictionary(str(tmp_path / "ja.csv"), str(tmp_path / "matrix.def")), "zh": tries.dictionary(str(tmp_path / "zh.txt"))}
    assert cut() == [["すもも", "も", "もも", "も", "もも", "の", "うち"], ["北京", "大学生", "前来", "应聘"], None, ["2", "words"], None] or cut()[1] == ["北京大学", "生", "前来", "应聘"]
    assert normalize.can_tokenize("zh") and not normalize.can_tokenize("th")
    from textgauge.plans import score

    record = [("one", "a", "ja", f"u{i}", "すもももももももものうち", t, 1.0, 1.0, "2026-07-05", "{}") for i, t in enumerate(["すもももももももものうち", "すもももももももうち", None])]
    scored = score.score_utterances(spark.createDataFrame(record, "engine_key string, track string, lang_key string, file_utt_id string, ref_text_raw string, text string, duration_sec double, latency_sec double, timestamp_utc string, params string"))
    cuts = normalize.dictionaries["ja"].cut
    lost = edit_ops(cuts("すもももももももものうち"), cuts("すもももももももうち"))
    assert sorted((r.utt_id, r.wer_errors, r.wer_len) for r in scored.collect()) == [("u0", 0, 7), ("u1", lost["sub"] + lost["del"] + lost["ins"], 7), ("u2", 7, 7)] and lost["del"]
