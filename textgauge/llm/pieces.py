"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a model file. A file made for merges holds ranks in place of log scores; there
the log score of a piece is that of Zipf's law for its rank, -ln(rank + 3), rounded to 1/1024 so that
sums are exact and ties fall the same way everywhere. Among paths of equal score the one whose last
piece begins first is taken. A character that no piece covers costs the lowest score less ten and is
written as its UTF-8 bytes.

Spaces become the marker U+2581, and one is set before the text. No piece holds a marker behind
another character, so the best path of a text is that of its words side by side, and the paths of
words seen before are remembered.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.llm.common import sliced, text_udf

MARK = "▁"
#: Words remembered by a worker, in each of two generations of some 200 bytes a word.
REMEMBERED = 120_000
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file: ordinary, unknown, control, user-defined, unused, byte.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def double_array(keys: list[bytes], values: list[int]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value of a trie over bytes: from state s, byte b leads to base[s] + b if that has check s."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, values = [keys[i] for i in order], [values[i] for i in order]
    base, check, value = [0], [-1], [-1]
    taken, floor = bytearray(b"\x01"), 1
    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[lo]) == depth:
            value[state] = values[lo]
            lo += 1
        if lo == hi:
            continue
        groups, at = [], lo
        while at < hi:
            b, end = keys[at][depth], at + 1
            while end < hi and keys[end][depth] == b:
                end += 1
            groups.append((b, at, end))
            at = end
        first = groups[0][0]
        place = max(floor, first + 1)
        while True:
            place = taken.find(0, place)
            if place < 0:
                place = len(taken)
            start = place - first
            if start + 256 > len(taken):
                grow = start + 256 - len(taken) + len(taken) // 2
                taken.extend(bytes(grow))
                for column, fill in ((base, 0), (check, -1), (value, -1)):
                    column.extend([fill] * grow)
            if not any(taken[start + b] for b, _, _ in groups):
                break
            place += 1
        if len(groups) == 1 and place > floor + 4096:
            floor += 1024  # the crowded beginning is not searched again
        base[state] = start
        for b, a, z in groups:
            taken[start + b] = 1
            check[start + b] = state
            todo.append((start + b, a, z, depth + 1))
    return base, check, value


class Pieces:
    """A model's pieces and their trie; each worker builds its own from the model's bytes.

    Models that rewrite texts (any normalization but the identity, white space removed, no marker
    before the text) are refused, as their ids would be others.
    """

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("the model normalizes texts in a way that is not done here")
        self.kinds = [p.type for p in spec.pieces]
        self.names = [p.piece for p in spec.pieces]
        ranks = spec.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.scores = [zipf(-p.score) if ranks else p.score for p in spec.pieces]
        live = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        for i in live:
            if MARK in self.names[i].lstrip(MARK):
                raise ValueError("a piece holds a marker behind another character")
        self.lowest = min(self.scores[i] for i in live)
        self.unknown = self.lowest - UNKNOWN_PENALTY
        self.unk_id = self.kinds.index(UNKNOWN)
        self.bytes = {int(self.names[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.trie = double_array([self.names[i].encode()[::-1] for i in live], live)  # read backwards from the end of a piece
        self.state: dict[bytes, tuple[float, int, int]] = {}  # best score, begin of the last piece and its id, for beginnings of words
        self.single = {x for i in live if len(x := self.names[i].encode()) <= 4 and len(self.names[i]) == 1}
        # marks that no piece has behind a letter or digit: a path never crosses from a word to one
        behind = {b for i in live for a, b in zip(self.names[i], self.names[i][1:]) if a.isalnum()}
        self.after_words = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in behind)
        self.tails: dict[str, bytes] = {}
        self.decoded = [self._raw(i) for i in range(len(self.names))]
        self.remembered = remembered
        self.new: dict[str, bytes] = {}  # ids as 32-bit integers
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop all words remembered."""
        self.state, self.new, self.old, self.tails = {}, {}, {}, {}

    def _raw(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.names[i].replace(MARK, " ").encode()

    def best_path(self, word: str) -> list[int]:
        """The ids of the best segmentation of a marked word.

        The best path to a place in a word depends only on what stands before it, so words that
        begin alike share it; from there each further end is reached by the pieces that end there.
        """
        raw = word.encode("utf-8", "replace")
        base, check, value = self.trie
        scores, n = self.scores, len(raw)
        state = self.state if n <= 64 else {}
        if len(state) > self.remembered:
            state.clear()
        state[b""] = (0.0, 0, -1)
        known = n
        while raw[:known] not in state:
            known -= 1
        for end in range(known + 1, n + 1):
            if end < n and raw[end] & 0xC0 == 0x80:
                continue  # inside a character
            best, node, at = None, 0, end
            lead = end - 1
            while raw[lead] & 0xC0 == 0x80:
                lead -= 1
            while at:
                at -= 1
                to = base[node] + raw[at]
                if check[to] != node or not to:
                    break
                node = to
                if (piece := value[node]) >= 0:
                    score = state[raw[:at]][0] + scores[piece]
                    if best is None or score >= best[0]:
                        best = (score, at, piece)
            if best is None or raw[lead:end] not in self.single:
                score = state[raw[:lead]][0] + self.unknown
                if best is None or score > best[0]:
                    best = (score, lead, -1)
            state[raw[:end]] = best
        out, at = [], n
        while at:
            _, start, piece = state[raw[:at]]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(raw[start:at])]
            else:
                out.append(self.unk_id)
            at = start
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, no begin or end marks; none for null and empty texts."""
        if not text:
            return np.zeros(0, np.int32)
        words = text.replace(MARK, " ").split(" ")
        if "" in words:
            joined, marks = [], ""
            for w in words:  # empty parts are further spaces, whose markers stand before the next word
                if w:
                    joined.append(marks + w)
                    marks = ""
                else:
                    marks += MARK
            words = joined + ([marks[1:]] if marks else [])
        found = list(map(self.new.get, words))
        if None in found:
            recall = self._marked
            found = [recall(w) if f is None else f for f, w in zip(found, words, strict=True)]
        return np.frombuffer(b"".join(found), np.int32)

    def _marked(self, word: str) -> bytes:
        """The best path of a word without its own first marker, under which it is remembered."""
        if (known := self.old.get(word)) is None:
            head = word.rstrip(self.after_words)
            if head and len(head) < len(word) and head[-1].isalnum():
                tail = word[len(head) :]
                if (end := self.tails.get(tail)) is None:
                    end = self._path([tail])
                    if len(self.tails) < 10_000:
                        self.tails[tail] = end
                known = (self.new.get(head) or self._marked(head)) + end
            else:
                known = self._path([p for p in _LINES.split(MARK + word) if p])
        if len(word) <= 64:
            if len(self.new) >= self.remembered:
                self.old, self.new = self.new, {}
            self.new[word] = known
        return known

    def _path(self, parts: list[str]) -> bytes:
        return array("i", [i for p in parts for i in self.best_path(p)]).tobytes()

    def decode(self, ids) -> str:
        """The text of ids: markers to spaces, runs of byte pieces to characters, the first space off."""
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


#: Line breaks are in no piece of more than one character, so paths never cross them; longer words are cut there.
_LINES = re.compile(r"(\n)")


def zipf(rank: float) -> float:
    return round(-math.log(max(0.0, rank) + 3) * 1024) / 1024 if rank < 1e6 else -32.0


_models: dict[bytes, Pieces] = {}


def _model(raw: bytes, remembered: int = REMEMBERED) -> Pieces:
    key = hashlib.sha256(raw).digest()
    if key not in _models:
        _models[key] = Pieces(raw)
    _models[key].remembered = remembered
    return _models[key]


def encode_documents(spark: SparkSession, docs: DataFrame, model: str, text: str = "text", to: str = "pieces", remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """`docs` with a struct column `to`: ids, n_tokens, n_fallback (byte pieces) and round_trip.

    round_trip says whether decoding the ids gives the text again; it does unless the text holds
    the marker character itself or no valid Unicode. Null and empty texts have no ids. A column named `to` is replaced. The model file is read on
    the driver and broadcast (a few MB). `remembered` bounds the words a worker keeps; with
    `forget` it drops them at the end of each task, where other work follows in the same workers.
    """
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def measured(pieces: Pieces, low: np.ndarray, texts: pa.Array) -> pa.Array:
        flat, ends, fallback, same = [], [0], [], []
        for t in texts:
            t = t.as_py() or ""
            ids = pieces.encode(t)
            same.append(pieces.decode(ids.tolist()) == t)
            flat.append(ids)
            ends.append(ends[-1] + len(ids))
            fallback.append(int(low[ids].sum()))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(np.diff(ends), pa.int64()), pa.array(fallback, pa.int64()), pa.array(same, pa.bool_())], names=["ids", "n_tokens", "n_fallback", "round_trip"])

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _model(shared.value, remembered)
        low = np.zeros(len(pieces.kinds), bool)
        low[list(pieces.bytes.values())] = True
        gc.disable()  # nothing here makes cycles, and the remembered words would be walked again and again
        try:
            for texts in sliced(batches):
                yield measured(pieces, low, texts)
        finally:
            if forget:
                pieces.forget()
            gc.enable()

    return docs.withColumn(to, text_udf(encoded, "struct<ids:array<int>,n_tokens:bigint,n_fallback:bigint,round_trip:boolean>")(F.col(text)))


def decode_documents(spark: SparkSession, encoded: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """`encoded` with the decoded text of the id lists in column `to`; null lists give null."""
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _model(shared.value)
        for lists in batches:
            yield pa.array([None if x is None else pieces.decode([i for i in x if i is not None]) for x in lists.to_pylist()], pa.string())

    return encoded.withColumn(to, text_udf(decoded, "string")(F.col(ids)))
