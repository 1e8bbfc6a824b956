"""Edit distance: totals by built-in expressions, the split into kinds by an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Distinct tokens of a pair that the built-in word distance can tell apart: code points beyond the first plane.
ALPHABET = 0x100000
#: Differing tokens beyond the difference of the lengths that the first band allows for.
FIRST_BAND = 64
#: Cells of alignment tables that one task is dealt: some ten seconds.
TASK_CELLS = 3e9
#: Cells of a table up to which all its columns are kept, two bits each.
HELD_BITS = 1 << 26


def _positions(tokens: Sequence, wanted: set) -> dict:
    """For each of the wanted tokens an integer whose bit i is set where it stands at place i."""
    places: dict = {}
    for i, t in enumerate(tokens):
        if t in wanted:
            places.setdefault(t, []).append(i)
    out, size = {}, len(tokens) // 8 + 1
    for t, at in places.items():
        raw = np.zeros(size * 8, np.uint8)
        raw[at] = 1
        out[t] = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")
    return out


class _Band:
    """The distance table of ref (down) and hyp (across) within a band of diagonals, a column a step, a bit a cell.

    Column j holds rows j - above to j + below: a diagonal is a bit that stays in its place. Rows above the table
    count as its first row, and a row that enters the band below is taken to cost one more than its diagonal
    neighbour, which is never too little. So a path that stays inside the band has its true cost.
    """

    def __init__(self, ref: Sequence, hyp: Sequence, above: int, below: int) -> None:
        self.hyp, self.above = hyp, above
        self.mask = (1 << (above + below + 1)) - 1
        self.places = _positions(ref, set(hyp))
        # the bits of column 0, in the window of column 1: rows 1 - above to 1 + below, of which those from 1 on cost one more each
        self.start = (self.mask >> above << above, 0)

    def columns(self, begin: int, end: int, down: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
        """For the columns after `begin` up to `end`: which cells equal their diagonal neighbour, and the vertical differences (+1, -1)
        in the window of the next column, from those of column `begin`."""
        mask, places, hyp, first = self.mask, self.places, self.hyp, begin - self.above
        plus, minus = down
        for j in range(begin, end):
            at = places.get(hyp[j], 0)
            at = (at >> first if first >= 0 else at << -first) & mask
            first += 1
            level = ((((at & plus) + plus) ^ plus) | at | minus) & mask
            right = minus | (mask ^ (level | plus))
            up = level >> 1
            plus, minus = (level & plus) | (mask ^ (up | right)), up & right
            yield level, plus, minus


def edit_ops(ref: Sequence, hyp: Sequence) -> dict[str, int]:
    """sub, del, ins and ref_len of the alignment found backwards from the end: match, else sub, else del, else ins.

    The table is kept as bit vectors of differences (which cells equal their diagonal neighbour, which exceed the cell above), a
    machine word for 30 cells, within a band that is widened until the distance fits in it. Every so many columns are kept and those
    between are computed again on the way back, so memory grows with the band times the root of the hypothesis.
    """
    n, m = len(ref), len(hyp)
    if not n or not m:
        return {"sub": 0, "del": n, "ins": m, "ref_len": n}
    gap, within = abs(n - m), FIRST_BAND
    while True:
        within = min(within, min(n, m))  # no alignment costs more than the longer length
        band = _Band(ref, hyp, within // 2 + 1 + max(0, m - n), within // 2 + 1 + max(0, n - m))
        final = 1 << (band.above + n - m)  # the diagonal that ends the table
        every = m if band.mask.bit_length() * m <= HELD_BITS else max(16, int(m**0.5))
        distance, kept, columns, j = gap, {0: band.start}, [], 0
        for column in band.columns(0, m, band.start):
            j += 1
            if not column[0] & final and j + n - m >= 1:
                distance += 1
            if every == m:
                columns.append(column)
            elif j % every == 0:
                kept[j] = column[1:]
        if distance - gap <= within:
            break
        within = min(16 * within, distance - gap)  # what was found is never too little, so this much is enough
    counts = {"sub": 0, "del": 0, "ins": 0}
    i, j, low = n, m, 0 if columns else m + 1
    while i and j:
        if j <= low:
            low = (j - 1) // every * every
            columns = list(band.columns(low, j, kept[low]))
        at = i - j + band.above
        if ref[i - 1] == hyp[j - 1]:  # then the cell equals its diagonal neighbour
            i, j = i - 1, j - 1
        elif not columns[j - low - 1][0] >> at & 1:
            counts["sub"] += 1
            i, j = i - 1, j - 1
        elif columns[j - low - 1][1] >> (at - 1) & 1:
            counts["del"] += 1
            i -= 1
        else:
            counts["ins"] += 1
            j -= 1
    counts["del"] += i
    counts["ins"] += j
    return counts | {"ref_len": n}


utterance_errors = edit_ops


def _edit_ops(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("sub", pa.int32()), ("del", pa.int32()), ("ins", pa.int32()), ("ref_len", pa.int32())])
    for refs, hyps in batches:
        yield pa.array([None if r is None else edit_ops(r, h or []) for r, h in zip(refs.to_pylist(), hyps.to_pylist(), strict=True)], kind)


def edit_split(ref: Column, hyp: Column) -> Column:
    """struct<sub,del,ins,ref_len> of two strings (by code point) or two token arrays; a null hypothesis is an empty one, a null reference gives null."""
    return arrow_udf(_edit_ops, "struct<sub:int,del:int,ins:int,ref_len:int>")(ref, hyp)


def by_cost(rows: DataFrame, cost: Column, each: float = TASK_CELLS) -> DataFrame:
    """`rows` dealt into partitions of about `each` of `cost`, at least as many as there are cores; null costs nothing.

    A table of n x m cells is worth as many rows of few cells as it takes as long. Costs are counted by class (a factor
    of 2^(1/4) wide, some 250 at most, which is all the driver sees); partitions are dealt to classes by their
    totals, heaviest first, and a row's place within its class comes from a hash of the row, so a task that is run again gets the same rows.
    """
    worth = F.greatest(F.coalesce(cost.cast("double"), F.lit(0.0)), F.lit(1.0))
    kind = F.floor(F.log2(worth) * 4).cast("int")
    totals = sorted(((r.k, r.t) for r in rows.groupBy(kind.alias("k")).agg(F.sum(worth).alias("t")).collect()), reverse=True)
    total = sum(t for _, t in totals)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(total) // int(each)))
    begins, at = [], 0.0
    for k, t in totals:
        begins += [F.lit(k), F.struct(F.lit(at / total), F.lit(t / total))]
        at += t
    if not begins:
        return rows
    span = F.element_at(F.create_map(*begins), kind)
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)) / float(1 << 40)
    # the share that lies before, scaled; rounding must not lead beyond the last partition
    slot = F.least(F.floor((span["col1"] + place * span["col2"]) * parts), F.lit(parts - 1))
    return rows.repartitionById(parts, slot.cast("int"))


def split_pairs(rows: DataFrame, ref: str, hyp: str, to: str = "ops") -> DataFrame:
    """`rows` with the split of every pair of token arrays or strings in column `to`; pairs are dealt over the tasks by the cells of their tables."""
    n, m = (F.size(c) if rows.schema[c].dataType.typeName() == "array" else F.char_length(c) for c in (ref, hyp))
    return by_cost(rows, n.cast("double") * m).withColumn(to, edit_split(F.col(ref), F.col(hyp)))


def char_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance by code point; a null hypothesis counts as empty."""
    return F.levenshtein(ref, F.coalesce(hyp, F.lit("")))


def word_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance of two token arrays.

    Every distinct token of the pair is given a character and the built-in distance compares the
    strings. No Python is involved. A pair with more distinct tokens than there are characters (some
    million) stops the query; `edit_split` has no such bound. A null hypothesis counts as empty, a
    null reference gives null.
    """
    hyp = F.coalesce(hyp, F.array().cast("array<string>"))

    def distance(pair: Column) -> Column:
        ref, hyp, known = pair["ref"], pair["hyp"], pair["known"]
        # position 1 becomes U+10000, and so on
        mark = lambda t: F.lpad(F.hex(F.array_position(known, t) + 0xFFFF), 8, "0")
        letter = lambda tokens: F.decode(F.unhex(F.concat_ws("", F.transform(tokens, mark))), "UTF-32")
        few = F.size(known) <= ALPHABET
        return F.when(few, F.levenshtein(letter(ref), letter(hyp))).otherwise(F.when(~few, F.raise_error(F.lit("too many distinct words for one pair")).cast("int")))

    # bound to a variable, so that the distinct tokens are found once a pair and not once a token
    pair = F.struct(ref.alias("ref"), hyp.alias("hyp"), F.array_distinct(F.concat(ref, hyp)).alias("known"))
    return F.transform(F.array(pair), distance)[0]
