"""Dictionaries of phrases: longest-match conversion, and words by the cheapest path through a lattice.

Both walk a trie of their entries. A dictionary is made from files, once in each process, and travels to the workers as the names of
these files, or with its entries where it has no files.
"""

from __future__ import annotations

import csv
import functools
import math
from collections.abc import Iterable, Iterator


class Trie:
    """Entries by key, and all keys that begin at a place of a text."""

    def __init__(self, entries: Iterable[tuple[str, object]] = ()) -> None:
        self.root: dict = {}
        for key, value in entries:
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value

    def prefixes(self, text: str, at: int) -> Iterator[tuple[int, object]]:
        """(end, value) of every key that `text` holds at `at`, the shortest first."""
        node = self.root
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            if "" in node:
                yield end + 1, node[""]


# --- conversion

#: Frequent traditional characters and their simplified ones. Fixed values; a full table is a parameter.
COMMON = (
    "萬万 與与 專专 業业 東东 兩两 嚴严 個个 為为 舉举 義义 樂乐 習习 鄉乡 書书 買买 亂乱 爭争 於于 雲云 產产 親亲 億亿 從从 們们 價价 眾众 優优 會会 傳传 傷伤 偉伟 體体 兒儿 黨党 關关 興兴 養养 內内 冊册 "
    "寫写 軍军 農农 決决 況况 凍冻 淨净 準准 涼凉 減减 幾几 擊击 劃划 劉刘 則则 剛刚 創创 別别 製制 辦办 務务 動动 勞劳 勢势 勝胜 區区 醫医 華华 協协 單单 賣卖 衛卫 歷历 壓压 縣县 參参 雙双 發发 變变 葉叶 "
    "號号 聽听 吳吴 員员 園园 國国 圖图 圓圆 聖圣 場场 壞坏 塊块 堅坚 聲声 處处 備备 複复 夠够 頭头 奪夺 婦妇 媽妈 孫孙 學学 寧宁 寶宝 實实 審审 寬宽 對对 導导 壽寿 將将 爾尔 層层 屬属 歲岁 島岛 師师 帶带 "
    "幫帮 庫库 應应 開开 異异 張张 這这 時时 電电 車车 氣气 點点 長长 門门 問问 間间 見见 說说 話话 語语 讀读 請请"
)
#: Phrases of which single characters would be converted wrongly. Fixed values.
PHRASES = "乾隆 乾隆|乾坤 乾坤|乾燥 干燥|乾淨 干净|餅乾 饼干|著作 著作|著名 著名|顯著 显著|看著 看着|瞭解 了解|明瞭 明了|皇后 皇后|以後 以后|之後 之后|頭髮 头发|理髮 理发|發現 发现|麵包 面包|徵求 征求|宮商角徵羽 宫商角徵羽|藉口 借口|狼藉 狼藉|覆蓋 覆盖|回覆 回复"


class Converter:
    """Text to text: at every place the longest phrase there, else the character's own entry, else the character."""

    def __init__(self, characters: dict[str, str], phrases: dict[str, str], files: tuple[str, ...] = ()) -> None:
        self.characters, self.phrases, self.files = characters, phrases, files
        self.single = str.maketrans(characters)
        self.trie = Trie(phrases.items())
        self.firsts = {p[0] for p in phrases}

    def __reduce__(self):
        return (converter, self.files) if self.files else (Converter, (self.characters, self.phrases))

    def __call__(self, text: str) -> str:
        if self.firsts.isdisjoint(text):
            return text.translate(self.single)
        out, at, held = [], 0, 0
        while at < len(text):
            found = None
            if text[at] in self.firsts:
                for found in self.trie.prefixes(text, at):  # noqa: B007 - the last is the longest
                    pass
            if found is None:
                at += 1
                continue
            out += [text[held:at].translate(self.single), found[1]]
            at = held = found[0]
        return "".join([*out, text[held:].translate(self.single)])

    def over(self, characters: dict[str, str]) -> Converter:
        """This one, with further characters that have no entry here."""
        return Converter(characters | self.characters, self.phrases)


@functools.cache
def converter(*files: str) -> Converter:
    """From files of two columns, key and values parted by a tab, values by spaces, of which the first counts (the form of the published tables);
    without files the frequent characters and phrases that are written down here."""
    if not files:
        return Converter({p[0]: p[1] for p in COMMON.split()}, dict(p.split(" ") for p in PHRASES.split("|")))
    entries: dict[str, str] = {}
    for path in files:
        with open(path, encoding="utf-8") as f:
            entries |= {key: values.split(" ")[0] for line in f if "\t" in line and not line.startswith("#") for key, values in [line.rstrip("\n").split("\t", 1)]}
    return Converter({k: v for k, v in entries.items() if len(k) == 1}, {k: v for k, v in entries.items() if len(k) > 1}, files)


# --- words

#: Costs of a character that no entry covers: by itself, and with each like neighbour that it takes with it.
UNKNOWN, UNKNOWN_MORE = 15_000, 1_000


def _like(c: str) -> str:
    return "digit" if c.isdigit() else "latin" if c.isascii() and c.isalpha() else "kana" if "ァ" <= c <= "ヿ" else c


class Dictionary:
    """Words by the cheapest path through the lattice of all entries that a text holds.

    entries: surface to [(left, right, cost)], the kinds that it shows to its neighbours. joins: (right, left) to the cost
    of a neighbourhood, 0 where there is none. Kind 0 is the edge of a text and of what is unknown. Runs of digits, of Latin letters and of
    long kana that no entry covers may be one word. Ties go to the path with the longer word at the end.
    """

    def __init__(self, entries: dict[str, list[tuple[int, int, float]]], joins: dict[tuple[int, int], float] | None = None, files: tuple[str, ...] = ()) -> None:
        self.entries, self.joins, self.files = entries, joins or {}, files
        self.trie = Trie(entries.items())

    def __reduce__(self):
        return (dictionary, self.files) if self.files else (Dictionary, (self.entries, self.joins))

    def nodes(self, text: str, at: int) -> Iterator[tuple[int, int, int, float]]:
        """(end, left, right, cost) of every word that may begin at `at`."""
        for end, kinds in self.trie.prefixes(text, at):
            for left, right, cost in kinds:
                yield end, left, right, cost
        kind, end = _like(text[at]), at + 1
        yield end, 0, 0, UNKNOWN
        while len(kind) > 1 and end < len(text) and _like(text[end]) == kind:
            end += 1
            yield end, 0, 0, UNKNOWN + UNKNOWN_MORE * (end - at - 1)

    def cut(self, text: str) -> list[str]:
        """Words of a text; white space parts words and is none."""
        return [word for part in text.split() for word in self._cut(part)]

    def _cut(self, text: str) -> list[str]:
        # for each place the best path to each kind that may stand before it: cost, where its last word began, and with what kind before that
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(text) + 1)]
        best[0][0] = (0.0, 0, 0)
        for at in range(len(text)):
            if not best[at]:
                continue
            for end, left, right, cost in self.nodes(text, at):
                total, before = min((had[0] + self.joins.get((kind, left), 0.0), kind) for kind, had in best[at].items())
                found = best[end].get(right)
                if found is None or total + cost < found[0]:
                    best[end][right] = (total + cost, at, before)
        _, kind = min((had[0] + self.joins.get((kind, 0), 0.0), kind) for kind, had in best[len(text)].items())
        words, end = [], len(text)
        while end:
            _, at, before = best[end][kind]
            words.append(text[at:end])
            end, kind = at, before
        return words[::-1]


@functools.cache
def dictionary(*files: str) -> Dictionary:
    """From files of entries (.csv: surface, left, right, cost, ...; .txt: word and frequency, parted by spaces) and of joins (.def: right, left, cost, after a first line of sizes)."""
    entries: dict[str, list[tuple[int, int, float]]] = {}
    joins: dict[tuple[int, int], float] = {}
    counts: dict[str, float] = {}
    for path in files:
        with open(path, encoding="utf-8", newline="") as f:
            if path.endswith(".csv"):
                for surface, left, right, cost, *_ in csv.reader(f):
                    entries.setdefault(surface, []).append((int(left), int(right), float(cost)))
            elif path.endswith(".def"):
                next(f)
                joins |= {(int(right), int(left)): float(cost) for right, left, cost in map(str.split, f)}
            else:
                counts |= {parts[0]: float(parts[1]) for line in f if len(parts := line.split()) > 1}
    total = math.fsum(counts.values())
    for word, n in counts.items():
        entries.setdefault(word, []).append((0, 0, -1000 * math.log(max(n, 0.5) / total)))
    return Dictionary(entries, joins, files)
