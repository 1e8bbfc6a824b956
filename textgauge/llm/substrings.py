"""Repeated passages by content-defined chunking with a gear hash.

A gear hash rolls over the bytes (h = 2 h + gear[byte], of which the last `WINDOW` bytes count
here); a word begins a new chunk where the hash of the bytes before it is the lowest among the
`REACH` words on either side, for about one word in seven. Cuts depend on nothing but those words,
so an insertion moves no cut further on, two copies of a passage are cut alike from some words on,
and no chunk has fewer than `REACH` + 1 words but a text's first and last. Chunks are grouped by a 96-bit digest;
one that stands in several documents belongs to the smallest id among them, and in the others runs
of such chunks with `min_words` words or more are repeated passages.

A passage is missed when fewer than `min_words` words lie between its first and its last cut: of
passages of 51 words and 20 words asked for, none of 4,000 drawn at random. Its first and last few words,
outside those cuts, are not part of what is reported. Where one to three words repeat over and over there
is no strict minimum: every 16th word, counted from where the repetition begins, is a cut. Repeats inside
one document are reported on demand (`inside`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import discard, sliced, text_udf, written

WINDOW = 8
REACH = 3
MIN_WORDS = 20
#: Words between cuts where one to three words repeat over and over.
CYCLE = 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte, from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


GEAR = _gear()


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks begin and end (bytes, white space at the end left out) and how many words they hold."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, starts
    h = GEAR[data]
    span = 1
    while span < WINDOW:  # a hash over twice the span is that of the later half plus the shifted one of the earlier
        h[span:] += h[:-span] << np.uint32(span)  # the right side is computed whole before it is added
        span *= 2
    v = np.full(len(starts) + 2 * REACH, 0xFFFFFFFF, np.uint32)
    v[REACH + 1 : REACH + len(starts)] = h[starts[1:] - 1]
    mid = v[REACH : REACH + len(starts)]
    cut = np.ones(len(starts), bool)
    for k in range(1, REACH + 1):
        cut &= (mid < v[REACH - k : REACH - k + len(starts)]) & (mid <= v[REACH + k : REACH + k + len(starts)])
    again = np.zeros(len(starts), bool)
    for k in range(1, min(REACH, len(starts) - 1) + 1):
        again[k:] |= mid[k:] == mid[:-k]
    turns = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
    for begin, end in turns.reshape(-1, 2).tolist():
        if end - begin >= CYCLE:
            cut[begin:end:CYCLE] = True
    cut[0] = True
    first = np.flatnonzero(cut)
    word_ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], word_ends[last], last - first + 1


def _chunked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in sliced(batches):
        parts, ends, digest = [], [0], xxhash.xxh3_128_digest
        for t in texts:
            raw = (t.as_py() or "").encode("utf-8", "replace")
            a, b, n = chunks(raw)
            keys = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(a.tolist(), b.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            parts.append((keys[:, 0], keys[:, 1].astype(np.int32), np.arange(len(a)), a, b - a, n))
            ends.append(ends[-1] + len(a))
        kinds = (np.int64, np.int32, np.int32, np.int32, np.int32, np.int32)
        flat = [pa.array(np.concatenate([p[i] for p in parts]).astype(k)) if parts else pa.array([], pa.from_numpy_dtype(k)) for i, k in enumerate(kinds)]
        rows = pa.StructArray.from_arrays(flat, names=["h", "g", "no", "a", "size", "n"])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _text_key(text: str) -> F.Column:
    """Tells apart the texts of rows that share an id, of which there may be very many (rows without one): a 128-bit digest, as two numbers."""
    digest = F.md5(F.col(text).cast("binary"))
    return F.struct(*(F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "hi"), (17, "lo"))))


_CHUNK = "array<struct<h:bigint,g:int,no:int,a:int,size:int,n:int>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, inside: bool = False) -> DataFrame:
    """One row per repeated passage, in every document but the first that has it; with `inside` also in that one, at every place but its first.

    Columns: id, text_key (digest of the text: hi, lo), first_byte, last_byte (exclusive), n_words, owner
    (the smallest id that has one of its chunks). Null and empty texts have no passages; a row
    without an id never owns a chunk; rows that share an id are one document. Exact copies are
    passages as long as the text.
    """
    keyed = docs.select(F.col(id_col).alias("id"), _text_key(text).alias("key"), text_udf(_chunked, _CHUNK)(F.col(text)).alias("c"))
    rows = keyed.select("id", "key", F.explode("c").alias("c")).select("id", "key", "c.*")
    table = written(rows, "chunks")
    ends = [F.min("id").alias("owner"), F.max("id").alias("other"), F.max(F.col("id").isNull()).alias("unnamed")]
    beyond = F.col("owner").isNotNull() & ((F.col("owner") < F.col("other")) | F.col("unnamed"))
    if inside:  # the first place as well; a chunk with a second one anywhere is a repeat
        place = F.when(F.col("id").isNotNull(), F.struct("id", "key", "no"))
        shared = table.groupBy("h", "g").agg(*ends, F.min(place).alias("first"), F.max(place).alias("last")).where(beyond | (F.col("first") < F.col("last")))
        met = table.join(shared.select("h", "g", "owner", "first").hint("merge"), ["h", "g"])
        met = met.where(~(F.col("id").eqNullSafe(F.col("owner")) & (F.col("key") == F.col("first.key")) & (F.col("no") == F.col("first.no"))))
    else:
        shared = table.groupBy("h", "g").agg(*ends).where(beyond)
        met = table.join(shared.select("h", "g", "owner").hint("merge"), ["h", "g"]).where(~F.col("id").eqNullSafe(F.col("owner")))
    by_text = Window.partitionBy("id", "key").orderBy("no")
    # rows that repeat a text and its id give every chunk as often; ranks and counts see it once
    runs = met.select("id", "key", "no", "a", "size", "n", "owner").withColumn("run", F.col("no") - F.dense_rank().over(by_text))
    words = F.expr("sum(n) * (max(no) - min(no) + 1) div count(*)")
    spans = runs.groupBy("id", "key", "run").agg(F.min("a").alias("first_byte"), F.max(F.col("a") + F.col("size")).alias("last_byte"), words.alias("n_words"), F.min("owner").alias("owner"))
    spans = spans.where(F.col("n_words") >= min_words)
    out = written(spans.select("id", F.col("key").alias("text_key"), "first_byte", "last_byte", "n_words", "owner"), "spans")
    discard(table)
    return out


def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in sliced(batches):
        out = []
        for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if not cut:
                out.append(text)
                continue
            raw, at, kept = text.encode("utf-8", "replace"), 0, []
            for s in sorted(cut, key=lambda s: s["first_byte"]):
                kept.append(raw[at : s["first_byte"]])
                at = max(at, s["last_byte"])
            kept.append(raw[at:])
            out.append("\n".join(x for x in (k.decode("utf-8").strip(" \t\n\r\x0b\x0c") for k in kept) if x))
        yield pa.array(out, pa.string())


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with repeated passages cut from all documents but the first that has each, columns unchanged.

    What stands before and after a cut is joined by a line break. A document of which nothing is
    left goes; one that had no passage stays as it is, a null or empty text too. A column n_chars
    is set anew where the text changed.
    """
    spans = repeated_spans(docs, id_col, text, min_words)
    per = spans.groupBy(F.col("id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_list(F.struct("first_byte", "last_byte")).alias("__cut"))
    keyed = docs.withColumn("__text_key", _text_key(text))
    joined = keyed.join(per.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & F.col("__text_key").eqNullSafe(F.col("__key")), "left")
    # only texts that lose something go to Python, and once: a filter on what comes back must not run it again
    left = text_udf(_without, "string").asNondeterministic()(F.when(F.col("__cut").isNotNull(), F.col(text)), F.col("__cut"))
    made = joined.withColumn("__new", left).withColumn("__new", F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.col("__new")))
    made = made.where(F.col("__cut").isNull() | (F.col("__new") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("__new").cast(kind)))
    return made.withColumn(text, F.col("__new")).select(*docs.columns)
