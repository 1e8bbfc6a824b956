"""Vector codes by product quantisation over integers, screened in single precision.

Components become integers, vectors are cut into parts, and each part of a vector is coded by the nearest of
its codebook's entries. The nearest entry is found in two steps. A float32 matrix product gives all
p.c of a tile of parts p with the entries c, and with the exact c.c an estimate of |p - c|^2 - p.p. For d
components, whatever the order of summation, the product is off by at most g |p||c|, g = k u / (1 - k u)
with k = d + 2 (the two roundings to single precision counted) and u = 2^-24. Entries whose interval
lies wholly above the lowest upper end are out; wherever more than one is left all of those are
computed anew in int64, and the lowest index among the least distances is taken. So the codes are those of
exact arithmetic, at the price of a single-precision product.

Codebooks are fitted by rounds over all rows: every task adds up its parts by entry, and only these sums (parts x
entries x components, whatever the number of rows) are shuffled and reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Components that a task handles at once.
AT_ONCE = 1 << 19
#: Labels up to which their sums are broadcast (some 40 bytes each); beyond, rows and sums are joined in this many parts a label.
MAX_SENT, SALTS = 100_000, 32
_UNIT = 2.0**-24


@dataclass
class Codebooks:
    """entries: (parts, entries, components of a part) integers."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x), computed in double precision (exact for a power of two)."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if (np.abs(scaled) >= 2.0**62).any():
        raise ArithmeticError("components are too large: they must fit in 64 bits")
    return scaled.astype(np.int64)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """Index of the nearest of `entries` for each of `points` (both integers), ties to the lower; and how many distances were computed in int64."""
    d = points.shape[1]
    k = (d + 2) * _UNIT
    g = k / (1 - k)
    near = points.astype(np.float32) @ entries.astype(np.float32).T
    squares = (entries * entries).sum(axis=1).astype(np.float64)
    point_norm = np.sqrt((points * points).sum(axis=1).astype(np.float64))
    estimate = squares - 2.0 * near.astype(np.float64)
    # the last term covers the roundings of this double-precision arithmetic itself, some eight of them, with room
    off = 2.0 * g * point_norm[:, None] * np.sqrt(squares) * (1 + 1e-12) + 2.0**-48 * (squares + 2.0 * point_norm[:, None] * np.sqrt(squares))
    possible = estimate - off <= (estimate + off).min(axis=1, keepdims=True)
    best = np.argmax(possible, axis=1)
    i, j = np.nonzero(possible & (possible.sum(axis=1) > 1)[:, None])
    if len(i):
        distance = ((points[i] - entries[j]) ** 2).sum(axis=1)
        order = np.lexsort((j, distance, i))
        first = order[np.concatenate(([True], np.diff(i[order]) > 0))]
        best[i[first]] = j[first]
    return best, len(i)


def _check(points: np.ndarray, entries: np.ndarray) -> None:
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if points.shape[1] * entries.shape[0] * (2 * most) ** 2 >= 1 << 63:
        raise ArithmeticError("components are too large: squared distances of whole vectors must fit in 64 bits")


def assign(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indexes, and squared distances summed over the parts, of integer vectors."""
    parts, _, d = entries.shape
    _check(vectors, entries)
    codes, error = np.empty((len(vectors), parts), np.int64), np.zeros(len(vectors), np.int64)
    for p in range(parts):
        points = vectors[:, p * d : (p + 1) * d]
        codes[:, p], _ = nearest(points, entries[p])
        error += ((points - entries[p][codes[:, p]]) ** 2).sum(axis=1)
    return codes, error


def is_whole(vector: str) -> Column:
    """True for vectors that are there and hold neither nulls nor non-finite components."""
    return F.coalesce(F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, Iterator[tuple[slice, np.ndarray]]]:
    """Which rows of a batch hold a whole vector, and these as integers, in slices of bounded size."""
    flat = column.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    whole = (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    if (sizes[whole] != dim).any():
        raise ValueError(f"vectors must have one length, here {dim}")
    at = (ends - np.maximum(sizes, 0))[whole]

    def slices():
        step = max(1, AT_ONCE // max(1, dim))
        for lo in range(0, len(at), step):
            hi = min(len(at), lo + step)
            yield slice(lo, hi), integers(values[at[lo:hi, None] + np.arange(dim)])

    return whole, slices()


def smallest_ids(ids: DataFrame, count: int) -> DataFrame:
    """(id): the smallest different ids, at most `count`; each task brings its own few, so that ids are not shuffled."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for batch in batches:
            column = batch.column(0).unique()
            least = column if least is None else pa.concat_arrays([least, column]).unique()
            least = least.take(pc.array_sort_indices(least)[:count])
        if least is not None:
            yield pa.RecordBatch.from_arrays([least], ["id"])

    return ids.mapInArrow(few, ids.schema).distinct().orderBy("id").limit(count)


def start(rows: DataFrame, id_col: str, vector: str, parts: int, entries: int) -> Codebooks:
    """Codebooks of the vectors of the smallest ids; of rows that share an id the smallest vector."""
    whole = rows.where(is_whole(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    ids = [r.id for r in smallest_ids(whole.select("id"), entries).collect()]
    found = whole.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect() if ids else []
    if not found:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    dim = len(found[0].v)
    if dim % parts or not dim or any(len(r.v) != dim for r in found):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    seeds = integers(np.array([r.v for r in found], np.float64))
    return Codebooks(np.ascontiguousarray(seeds.reshape(len(found), parts, dim // parts).transpose(1, 0, 2)))


def sums_by_entry(rows: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """(slot, n, total): how many parts each entry is nearest to, and the sums of their components; slot numbers (part, entry, position)."""
    parts, count, d = books.entries.shape
    entries = books.entries

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, bound = np.zeros((parts, count), np.int64), np.zeros((parts, count, d), np.int64), 0

        def out() -> pa.RecordBatch:
            used = np.flatnonzero(np.repeat(n.ravel(), d))
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.repeat(n.ravel(), d)[used]), pa.array(total.ravel()[used])], ["slot", "n", "total"])

        for batch in batches:
            for _, vectors in _rows(batch.column(0), parts * d)[1]:
                most = int(np.abs(vectors).max(initial=0)) * len(vectors)
                if bound + most >= 1 << 62:  # sums go out before they could overflow
                    yield out()
                    n[:], total[:], bound = 0, 0, 0
                bound += most
                codes, _ = assign(vectors, entries)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], vectors[:, p * d : (p + 1) * d])
                    n[p] += np.bincount(codes[:, p], minlength=count)
        yield out()

    made = rows.select(vector).mapInArrow(add, "slot int, n long, total long")
    return made.groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def fit(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after `rounds` rounds over all rows; entries that no part is nearest to stay. Means are rounded down."""
    books = start(rows, id_col, vector, parts, entries)
    if not books.entries.size:
        return books
    for _ in range(rounds):
        flat = books.entries.copy().ravel()
        for r in sums_by_entry(rows, vector, books).collect():
            flat[r.slot] = int(r.total) // r.n
        books = Codebooks(flat.reshape(books.entries.shape))
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding", to: str = "coded") -> DataFrame:
    """`rows` of whole vectors with a column `to` (codes: array of indexes in the order of the parts; error: long); other rows go."""
    parts, count, d = books.entries.shape
    kept = rows.where(is_whole(vector))
    kind = "struct<codes:array<smallint>,error:bigint>"
    if not count:
        return kept.withColumn(to, F.lit(None).cast(kind))
    entries = books.entries

    @F.arrow_udf(kind)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            codes, error = np.empty((len(column), parts), np.int16), np.empty(len(column), np.int64)
            for where, vectors in _rows(column, parts * d)[1]:
                codes[where], error[where] = assign(vectors, entries)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            yield pa.StructArray.from_arrays([lists, pa.array(error)], names=["codes", "error"])

    return kept.withColumn(to, coded(F.col(vector)))


def decode(rows: DataFrame, books: Codebooks, codes: str = "coded.codes", to: str = "decoded") -> DataFrame:
    """`rows` with the integer vector that its codes stand for; built-in expressions only."""
    book = F.lit(None) if not books.entries.size else F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in part)) for part in books.entries.tolist()))
    each = F.transform(F.col(codes), lambda c, p: F.element_at(F.element_at(book, p + 1), c.cast("int") + 1))
    return rows.withColumn(to, F.flatten(each).cast("array<bigint>"))


def hex_code(codes: Column) -> Column:
    """Indexes in two lower-case hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", to: str = "label_error") -> DataFrame:
    """`coded` with its errors summed over equal labels, nulls together. Sums are combined before the shuffle, and no label's rows meet in one task."""
    table = written(coded, "coded")
    sums = written(table.groupBy(F.col(label).alias("__label")).agg(F.sum(error).alias(to)), "sums")
    if sums.count() <= MAX_SENT:
        out = table.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("__label")))
    else:
        dealt = table.withColumn("__salt", F.pmod(F.xxhash64(*coded.columns), F.lit(SALTS)))
        parts = sums.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = dealt.join(parts, (F.col("__salt") == F.col("__part")) & F.col(label).eqNullSafe(F.col("__label")))
    return out.select(*coded.columns, to)


def compress(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(id_col, label, codes, error, label_error) for every row with a whole vector, and the codebooks.

    Rows whose vector is null or holds null or non-finite components go, and take no part in the fit.
    A row without an id is coded, but is no start of an entry; repeated rows are rows. Fewer ids than `entries` make as many
    entries. No rows, no codes. Vectors of different lengths, of a length that `parts` does not divide (an empty
    vector too), and components so large that squared distances overflow 64 bits are refused.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    books = fit(rows, id_col, vector, parts, entries, rounds)
    coded = encode(rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")), books, "v")
    out = with_label_error(coded.select("id", "label", "coded.codes", "coded.error"))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label), "codes", "error", "label_error"), books

