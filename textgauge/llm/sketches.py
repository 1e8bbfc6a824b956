"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction of their range.

Two sketches are complete below the same threshold, so set sizes and overlaps below it estimate those of the
whole texts, however unequal their lengths; and the sketch of a union is the union of sketches. Texts with few
shingles have few hashes, or none, below the threshold: there the `LEAST` smallest hashes are kept as well. That
keeps sketches mergeable (the smallest of a union are among the smallest of its parts), and from the hashes alone
it is plain up to where a sketch is complete: below the threshold if it has `LEAST` hashes there, else up to
its largest hash, or everywhere if it has fewer than `LEAST`. Two sketches are compared up to where both are
complete.

A shingle is `WIDTH` words (runs of anything but ASCII white space, A-Z lower-cased); a shorter text is one shingle,
a text without words has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import sliced, text_udf, written

#: Hashes have 48 bits: sets of a billion share one by chance with odds of some four in a million for each hash looked up.
WIDTH, FRACTION, LEAST, SEED, RANGE = 5, 16, 32, 42, 1 << 48
THRESHOLD = RANGE // FRACTION
#: Words hashed at once; bounds the memory a very long text takes.
STEP = 1 << 18
#: Odd factors that tell the places of a shingle's words apart, and those of the final mixing. Fixed values.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return (x ^ (x >> np.uint64(31))) >> np.uint64(16)


def _kept(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes, sorted."""
    low = np.unique(hashes[hashes < np.uint64(THRESHOLD)])
    return low if len(low) >= LEAST else np.unique(hashes)[:LEAST]


def sketch(text: str | None) -> np.ndarray:
    """Sorted hashes that a text keeps."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.array([], np.uint64)
    if len(words) < WIDTH:
        return _mixed(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    out, digest = np.array([], np.uint64), xxhash.xxh64_intdigest
    for at in range(0, len(words) - WIDTH + 1, STEP):
        some = words[at : at + STEP + WIDTH - 1]
        h = np.fromiter(map(digest, some), np.uint64, len(some))
        n = len(h) - WIDTH + 1
        total = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            total += h[k : k + n] * _PLACES[k]
        out = _kept(np.concatenate((out, _mixed(total))))
    return out


def merged(sketches: list[np.ndarray]) -> np.ndarray:
    """The sketch of all the texts of these sketches together."""
    return _kept(np.concatenate([np.array([], np.uint64), *sketches]))


def complete_below(s: np.ndarray) -> int:
    """Every shingle hash of the text below this number is in its sketch."""
    if len(s) < LEAST:
        return RANGE
    return max(THRESHOLD, int(s[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has. Equal sketches: 1; else 0 where a has no hash within what both cover."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    end = np.uint64(min(complete_below(a), complete_below(b)))
    a, b = a[: np.searchsorted(a, end)], b[: np.searchsorted(b, end)]
    return float(len(np.intersect1d(a, b, assume_unique=True)) / len(a)) if len(a) else 0.0


def packed(s: np.ndarray) -> bytes:
    """Six bytes a hash, the highest first."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def _sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in sliced(batches):
        yield pa.array([packed(sketch(t.as_py())) for t in texts], pa.binary())


def sketches(docs: DataFrame, text: str = "text", to: str = "sketch") -> DataFrame:
    """`docs` with the sketch of `text` in a binary column `to` (6 bytes a hash, big-endian, ascending); null and empty texts have an empty one."""
    return docs.withColumn(to, text_udf(_sketches, "binary")(F.col(text)))


def _contained(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for one, other in batches:
        pairs = zip(one.to_pylist(), other.to_pylist(), strict=True)
        yield pa.array([None if a is None or b is None else containment(unpacked(a), unpacked(b)) for a, b in pairs], pa.float64())


def contained(one: Column, other: Column) -> Column:
    """Share of the first sketch's text that the second's has; null for a null sketch."""
    return F.arrow_udf(_contained, "double")(one, other)


def _hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        parts = [unpacked(x or b"").view(np.int64) for x in column.to_pylist()]
        ends = np.cumsum([0, *map(len, parts)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.array([], np.int64), *parts])))


def group_containment(sketched: DataFrame, group: str, id_col: str = "doc_id", to: str = "sketch") -> DataFrame:
    """(id_col, group, shared): how much of each sketched row is in the merged sketch of each group that shares a kept hash with it, its own included.

    A merged sketch is a set of (group, hash) rows here, as a group may hold most of the corpus; only hashes below the
    threshold take part, where every sketch is complete. Rows of the result are bounded by hashes times groups; a hash that very many
    rows keep meets one row a group. Rows without a hash below the threshold are in no group; a null group is one.
    """
    below = F.filter(F.arrow_udf(_hashes, "array<bigint>")(F.col(to)), lambda h: h < THRESHOLD)
    rows = written(sketched.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(to).alias("k"), below.alias("hs")), "sketches")
    each = rows.select("id", "g", "k", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    members = each.select(F.col("g").alias("other"), "h").distinct()
    met = each.select("id", "k", "n", "h").distinct().join(members, "h")
    shared = met.groupBy("id", "k", "n", "other").agg((F.count("*") / F.col("n")).alias("shared"))
    return shared.select(F.col("id").alias(id_col), F.col("other").alias(group), "shared")


#: What `edited_likeness` returns of each row.
_LIKENESS = "id_ long, n_chars long, edited_sha256 binary, sketch binary, edited_sketch binary, near_edited double, near_next double"
_FIELDS = pa.schema([("id_", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("sketch", pa.binary()), ("edited_sketch", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def _edited(text: str, after: str) -> str:
    """`text` with its last third (rounded down) replaced by as many characters of the beginning of `after`, or all of them."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _likeness(text: str, own: np.ndarray, after: str, next_sketch: np.ndarray) -> tuple:
    new = _edited(text, after)
    changed = own if new == text else sketch(new)
    return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), packed(own), packed(changed), containment(own, changed), containment(own, next_sketch)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next for every row.

    The rows form a circle: ids from high to low, those without one last, rows of one id by the hash of
    their text and the text itself. The edited text is the row's, its last third replaced by the beginning of the next row's; near_edited and
    near_next are the shares of the row's shingles that the edited text and the next row have. A single row is
    its own next. Null texts are empty; empty texts are alike. Texts are shuffled once, by ranges of ids; a task
    holds two of them at a time. The ends of the ranges, one text for each, are joined by the number of the range.
    """
    kind = docs.schema[id_col].dataType
    t = F.coalesce(F.col(text), F.lit(""))
    order = [F.desc_nulls_last("id"), F.asc("h"), F.asc("t")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))
    # sampled and cut by id and hash alone, so that no texts go to the driver
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("id", "t", F.spark_partition_id().alias("range"))
    names = _FIELDS.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose next is in the same range; of the first and last rows of a range, their texts."""
        fields = pa.schema([("range", pa.int32()), ("place", pa.string()), ("text", pa.string()), *_FIELDS])
        held, seen, none = None, 0, (None,) * (len(names) - 1)
        for batch in batches:
            for texts, ids, ranges in sliced(iter([(batch.column(1), batch.column(0), batch.column(2))])):
                out = []
                for now, id_, at in zip(texts.to_pylist(), ids.to_pylist(), ranges.to_pylist(), strict=True):
                    own = sketch(now)
                    if held is None:
                        out.append((at, "first", now, id_, *none))
                    else:
                        out.append((at, "row", None, held[0], *_likeness(held[1], held[2], now, own)))
                    held, seen = (id_, now, own), at
                yield _batch(out, fields)
        if held is not None:
            yield _batch([(seen, "last", held[1], held[0], *none)], fields)

    table = written(dealt.mapInArrow(walk, f"range int, place string, text string, {_LIKENESS}"), "likeness")
    done = table.where("place = 'row'").select(*names)
    firsts = table.where("place = 'first'").select("range", F.col("text").alias("after"))
    # one row a range: the order of ranges is settled without their texts
    ranges = firsts.select("range")
    after = ranges.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy(F.lit(0)))).alias("next"))
    lasts = table.where("place = 'last'").select("range", "id_", "text").join(after, "range")
    ends = lasts.join(firsts.withColumnRenamed("range", "next"), "next").select("id_", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, now, then in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield _batch([(id_, *_likeness(now, sketch(now), then, sketch(then)))], _FIELDS)

    out = done.union(ends.mapInArrow(close, _LIKENESS))
    return out.select(F.col("id_").cast(kind).alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), *names[3:])
