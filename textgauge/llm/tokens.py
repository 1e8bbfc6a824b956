"""Exact byte-level BPE token counts of every prefix of a text, by dynamic programming.

For each end position the last token of the encoding is the one token that ends there and that
stands next to the last token before it exactly as the merges would leave the two; the count is
one more than the count where that token starts. The counts of all prefixes of a text are so
stored once, and questions about truncation and budgets are answered from them.

Merges never cross the pieces that the split pattern cuts, so the programme runs over one piece
at a time and its counts are remembered for pieces seen before; a text is the concatenation of
its pieces. Where a prefix would be cut otherwise than the whole text (at the end of a run of
white space, inside a contraction, inside a special string), the counts there are those of the
prefix.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.llm.common import sliced, text_udf

#: The pattern by which byte-level BPE of this kind cuts a text into pieces. A fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker, in each of two generations.
REMEMBERED = 150_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by rule.

    Bytes that print as themselves in Latin-1 stay; the others take the code points from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class PrefixCounter:
    """Counts for one vocabulary file of the `tokenizers` library (byte-level BPE), given as its bytes."""

    def __init__(self, vocabulary: bytes, remembered: int = REMEMBERED):
        spec, letters = json.loads(vocabulary), byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.gaps = regex.compile(r"\s{2,}(?=\S)")
        self.endings = {t[i:] for t in self.ids for i in range(len(t))}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.new: dict[str, bytes | np.ndarray] = {}
        self.old: dict[str, bytes | np.ndarray] = {}
        self.chunks: dict[str, bytes | np.ndarray] = {}
        self.old_chunks: dict[str, bytes | np.ndarray] = {}
        self.state: dict[bytes, tuple[bytes, bytes]] = {}  # last token and counts of beginnings of pieces
        self.remembered = remembered

    def merge(self, piece: bytes) -> list[bytes]:
        """The encoding of a short piece by applying the merges in order of rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            at, out = 0, []
            while at < len(parts):
                if at < len(ranks) and ranks[at] == low:
                    out.append(parts[at] + parts[at + 1])
                    at += 2
                else:
                    out.append(parts[at])
                    at += 1
            parts = out
        return parts

    def _stand(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave a and b as they are when they stand side by side."""
        if (known := self.beside.get((a, b))) is None:
            if len(self.beside) > 4 * self.remembered:
                self.beside.clear()
            known = self.beside[a, b] = self.merge(a + b) == [a, b]
        return known

    def bytes_counts(self, piece: bytes) -> bytes | list[int]:
        """The number of tokens of piece[:1], piece[:2], ... as the merges give them for each prefix alone."""
        if len(piece) > 64:
            return self._long_counts(piece)
        ids, endings, beside, state = self.ids, self.endings, self.beside, self.state
        if len(state) > 2 * self.remembered:
            state.clear()
        state[b""] = (b"", b"")
        known = len(piece)
        while piece[:known] not in state:  # words that start alike share what is known of their beginnings
            known -= 1
        counts = state[piece[:known]][1]
        for end in range(known + 1, len(piece) + 1):
            start, t = end - 1, piece[end - 1 : end]
            while t in endings:
                if t in ids:
                    last = state[piece[:start]][0]
                    if not start or (self._stand(last, t) if (ok := beside.get((last, t))) is None else ok):
                        break  # exactly one token fits
                start -= 1
                if start < 0:
                    raise ValueError("a byte is missing from the vocabulary")
                t = piece[start:end]
            else:
                raise ValueError("a byte is missing from the vocabulary")
            counts += bytes((counts[start - 1] + 1 if start else 1,))
            state[piece[:end]] = (t, counts)
        return counts

    def _long_counts(self, piece: bytes) -> list[int]:
        """As bytes_counts, for a piece that is not worth remembering."""
        last, counts = [b""], [0]
        for end in range(1, len(piece) + 1):
            start = end - 1
            while (t := piece[start:end]) not in self.ids or (start and not self._stand(last[start], t)):
                start -= 1
                if start < 0 or piece[start:end] not in self.endings:
                    raise ValueError("a byte is missing from the vocabulary")
            last.append(t)
            counts.append(counts[start] + 1)
        return counts[1:]

    def piece_counts(self, piece: str) -> bytes | np.ndarray:
        """As bytes_counts, at the ends of characters only; bytes where all counts fit in one."""
        raw = piece.encode("utf-8", "replace")
        counts = self.bytes_counts(raw)
        if len(raw) != len(piece):
            ends = np.cumsum([len(c.encode("utf-8", "replace")) for c in piece]) - 1
            counts = [counts[i] for i in ends]
        if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
            counts = [counts[0], counts[0] + self.bytes_counts(raw[1:2])[0], counts[2]]  # cut short it is no contraction
        return bytes(counts) if counts[-1] < 256 else np.array(counts, np.int32)

    def _recall(self, piece: str) -> bytes | np.ndarray:
        if (known := self.old.get(piece)) is None:
            known = self.piece_counts(piece)
        if len(piece) <= 64:
            if len(self.new) >= self.remembered:
                self.old, self.new = self.new, {}
            self.new[piece] = known
        return known

    def _chunk(self, part: str) -> bytes | np.ndarray | bool:
        """The counts of a space and what follows up to the next one; False where the cuts depend on more."""
        if not part or part[0].isspace() or part[-1].isspace():
            return False
        if (known := self.old_chunks.get(part)) is None:
            known = self._pieces_of(" " + part, part.isalpha())
        if len(part) <= 64:
            if len(self.chunks) >= self.remembered:
                self.old_chunks, self.chunks = self.chunks, {}
            self.chunks[part] = known
        return known

    def _pieces_of(self, chunk: str, one: bool) -> bytes | np.ndarray:
        """The counts of a chunk, joined without numpy where it is short; one: it is a single piece."""
        if not one and len(pieces := self.split.findall(chunk)) > 1:
            if len(chunk) > 60 or self.gaps.search(chunk):
                return self.piecewise(chunk)
            out = bytearray()
            for piece in pieces:
                base = out[-1] if out else 0
                known = self.new.get(piece) or self._recall(piece)  # short: bytes, never empty
                out += bytes([base + n for n in known]) if base else known
            return bytes(out)
        return self.new.get(chunk) or self._recall(chunk)

    def _joined(self, counts: list[bytes | np.ndarray]) -> np.ndarray:
        """Counts of the prefixes of a text, from those of the pieces that follow one another."""
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        if np.ndarray not in set(map(type, counts)):
            flat = np.frombuffer(b"".join(counts), np.uint8).astype(np.int64)
        else:
            flat = np.concatenate([np.frombuffer(c, np.uint8) if type(c) is bytes else c for c in counts]).astype(np.int64)
        totals = flat[np.cumsum(sizes) - 1]
        flat += np.repeat(np.cumsum(totals) - totals, sizes)
        return flat

    def piecewise(self, text: str) -> np.ndarray:
        """The counts of every prefix of a text without special strings, cut by the split pattern."""
        pieces = self.split.findall(text)
        counts = list(map(self.new.get, pieces))
        if None in counts:
            recall = self._recall
            counts = [recall(p) if c is None else c for c, p in zip(counts, pieces, strict=True)]
        flat = self._joined(counts)
        for m in self.gaps.finditer(text):
            # the last character of such a run goes with what follows; a prefix ending there keeps the run whole
            flat[m.end() - 1] = (flat[m.start() - 1] if m.start() else 0) + int(self._recall(m[0])[-1])
        return flat

    def plain_counts(self, text: str) -> np.ndarray:
        """As piecewise, but cut at single spaces first, where the pattern always cuts."""
        if not text:
            return np.zeros(0, np.int64)
        first, *parts = text.split(" ")
        if not parts or not first or first[-1].isspace():
            return self.piecewise(text)
        counts = list(map(self.chunks.get, parts))
        if None in counts:
            chunk = self._chunk
            counts = [chunk(p) if c is None else c for c, p in zip(counts, parts, strict=True)]
            if bool in set(map(type, counts)):
                return self.piecewise(text)
        head = self.piecewise(first)
        return np.concatenate((head, self._joined(counts) + head[-1]))

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of every prefix, in characters; element i is for text[: i + 1]. Empty for null and empty texts."""
        text = text or ""
        if self.find_special is None or not any(s in text for s in self.special):
            return self.plain_counts(text)
        out, base, at = [], 0, 0
        for m in self.find_special.finditer(text):
            part = self.plain_counts(text[at : m.end() - 1])  # up to its last character it is ordinary text
            before = int(part[m.start() - at - 1]) if m.start() > at else 0
            out += [base + part, np.array([base + before + 1])]
            base, at = base + before + 1, m.end()
        return np.concatenate([*out, base + self.plain_counts(text[at:])])


_counters: dict[bytes, PrefixCounter] = {}


def _counter(vocabulary: bytes, remembered: int = REMEMBERED) -> PrefixCounter:
    """One counter for each vocabulary in a worker."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _counters:
        _counters[key] = PrefixCounter(vocabulary)
    _counters[key].remembered = remembered
    return _counters[key]


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, limits: tuple[int, ...] = (1024,), text: str = "text", to: str = "tokens", keep_prefixes: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """`docs` with a struct column `to`, filled from the prefix counts of `text`.

    Its fields: n_bytes and n_tokens of the whole text; cut_<limit>, for each limit the number of
    characters of the longest prefix that has at most so many tokens; with keep_prefixes also
    prefix_tokens, the counts of every prefix. A null text counts as an empty one: zeros and no
    prefixes. Extra columns and repeated rows pass through; a column named `to` is replaced. The vocabulary file is read on the
    driver and its bytes (a few MB) are broadcast. `remembered` bounds the pieces a worker keeps.
    """
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fields = ["n_bytes bigint", "n_tokens bigint", *(f"cut_{k} bigint" for k in limits), *["prefix_tokens array<int>"] * keep_prefixes]

    def measured(counter: PrefixCounter, texts: pa.Array) -> pa.Array:
        rows, prefixes = [], []
        for t in texts:
            t = t.as_py() or ""
            counts = counter.prefix_counts(t)
            n = int(counts[-1]) if len(counts) else 0
            # prefix counts can dip where a longer prefix merges better, so the longest one is the last that fits
            cuts = [len(counts) if n <= k else int(len(counts) - np.argmax(counts[::-1] <= k)) if (counts <= k).any() else 0 for k in limits]
            rows.append([len(t.encode("utf-8", "replace")), n, *cuts])
            if keep_prefixes:
                prefixes.append(counts.astype(np.int32))
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * (2 + len(limits)))]
        if keep_prefixes:
            columns.append(pa.array(prefixes, pa.list_(pa.int32())))
        return pa.StructArray.from_arrays(columns, names=[f.split()[0] for f in fields])

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(shared.value, remembered)
        gc.disable()  # nothing here makes cycles, and the remembered pieces would be walked again and again
        try:
            for texts in sliced(batches):
                yield measured(counter, texts)
        finally:
            gc.enable()

    return docs.withColumn(to, text_udf(counted, f"struct<{','.join(x.replace(' ', ':') for x in fields)}>")(F.col(text)))
