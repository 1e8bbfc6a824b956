"""Seeded bootstrap intervals and tie groups.

The published method resamples a cell by index, with the stated generator and seed, in the order of
its utterance ids; engines of one (track, language) share their resamples. The index stream is drawn in segments (`stream`), so that no
task holds a cell and none draws for all resamples: utterances are numbered by sorted ranges, dealt into blocks of
`BLOCK`, one array for each member, and each block meets each segment of its stream in a task of its own, which counts how often each
resample chooses an utterance and multiplies these counts by the values of all members at once. Sums by resample are combined by grouping. They equal those of one draw bit for bit, as
sums of whole numbers do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgauge.operators import stream
from textgauge.plans.session import dealt, materialized

RESAMPLES = 10_000
#: The published seed and interval. Fixed values.
SEED = 20_260_704
INTERVAL = (2.5, 97.5)
#: Utterances of a block, for each member of a frame of MEMBERS or more: some 12 MB as a task holds them. A frame of fewer has as much larger blocks.
BLOCK = 1 << 18
#: Cells of a frame, which share the drawing; bounds what a task holds.
MEMBERS = 16
#: Segments up to which their table is broadcast (some 50 bytes each).
MAX_SENT = 1_000_000
#: Numbers drawn at once by the functions over lists; bounds memory.
_AT_ONCE = 8_000_000
#: From so many utterances on the choices of a resample are counted by themselves.
_LONG = 1 << 12


def _rates(errors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.divide(errors, lengths, out=np.zeros_like(errors, dtype=np.float64), where=lengths != 0)


def _index_sums(columns: list[np.ndarray], n: int, seed: int) -> list[np.ndarray]:
    """Sums of each column over n resamples by index; drawn in parts, which give the same stream as one draw."""
    rng, size = np.random.default_rng(seed), len(columns[0])
    out = [np.empty(n) for _ in columns]
    step = max(1, _AT_ONCE // size)
    for at in range(0, n, step):
        idx = rng.integers(0, size, size=(min(step, n - at), size))
        for sums, column in zip(out, columns, strict=True):
            sums[at : at + len(idx)] = column[idx].sum(axis=1)
    return out


def _counts(idx: np.ndarray, ends: np.ndarray, low: int, wide: int, size: int) -> np.ndarray:
    """For the parts of `idx` between `ends`, how often each chooses the `wide` utterances of `size` from `low` on. Long parts are counted one by one, so that the counts stay in a core's cache."""
    n, whole = len(ends) - 1, wide == size
    if size < _LONG:
        row = np.repeat(np.arange(n) * wide - low, np.diff(ends))
        chosen = row + idx if whole else (row + idx)[(idx >= low) & (idx < low + wide)]
        return np.bincount(chosen, minlength=n * wide).reshape(-1, wide).astype(np.float64)
    out = np.empty((n, wide))
    for counts, a, b in zip(out, ends[:-1], ends[1:], strict=True):
        chosen = idx[a:b] if whole else idx[a:b] - low
        counts[:] = np.bincount(chosen if whole else chosen[chosen.view(np.uint64) < wide], minlength=wide)
    return out


def _bounds(stat: np.ndarray) -> tuple[float, float]:
    lo, hi = np.percentile(stat, INTERVAL)
    return float(lo), float(hi)


def bootstrap_ci(errors, lengths, n: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the corpus rate."""
    return _bounds(_rates(*_index_sums([np.asarray(errors, np.float64), np.asarray(lengths, np.float64)], n, seed)))


def paired_diff_ci(errors_a, lengths_a, errors_b, lengths_b, n: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """Interval of rate a less rate b over the same resamples; the lists must be as long as each other."""
    if len(errors_a) != len(errors_b):
        raise ValueError("paired lists differ in length")
    ea, ra, eb, rb = _index_sums([np.asarray(x, np.float64) for x in (errors_a, lengths_a, errors_b, lengths_b)], n, seed)
    return _bounds(_rates(ea, ra) - _rates(eb, rb))


def fold_tiers(order: list[str], tied) -> list[list[str]]:
    """Tiers of engines in rank order: one joins the present tier if tied(leader, engine), else it leads a new one."""
    groups: list[list[str]] = []
    for engine in order:
        if groups and tied(groups[-1][0], engine):
            groups[-1].append(engine)
        else:
            groups.append([engine])
    return groups


def tie_groups(engines: dict[str, tuple[list, list]], n: int = RESAMPLES, seed: int = SEED) -> list[list[str]]:
    """Tiers of a few engines held in memory: name to (errors, lengths)."""

    def rate(name: str) -> float:
        e, r = map(sum, engines[name])
        return e / r if r else float(bool(e))

    def tied(leader: str, engine: str) -> bool:
        lo, hi = paired_diff_ci(*engines[engine], *engines[leader], n, seed)
        return lo <= 0 <= hi

    return fold_tiers(sorted(sorted(engines), key=rate), tied)


# --- frames: sets of utterances that are resampled alike; the members of a frame have the same ones


def _numbered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """`rows` (frame, member, o, k, e, r) with pos, counted from 0 in the order of o and k, and size, the number of the member's rows; the greatest size, and the most members of a frame.

    The whole table is sorted in ranges; a row's place in its range comes with it, and the counts of the ranges
    before are added. Neither the sort nor the count brings a frame into one task.
    """
    order = ["frame", "member", F.asc_nulls_last("o"), "k"]
    laid = materialized(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    whole = Window.partitionBy("frame", "member")
    ranges = laid.groupBy("frame", "member", "range").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialized(ranges.select("frame", "member", "range", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("size")))
    most, members = ranges.groupBy("frame").agg(F.max("size").alias("size"), F.count_distinct("member").alias("n")).agg(F.max("size"), F.max("n")).first()
    return laid.join(ranges, ["frame", "member", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "range"), most or 0, members or 0


def _segment_table(sizes: DataFrame, n: int, seed: int, numbers) -> DataFrame:
    """(size, segment, segments, start): the segments of each size's stream, and the number of indexes before each."""

    @F.arrow_udf("long")
    def how_many(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([stream.segments(n * s, s, numbers(s)) for s in column.to_pylist()], pa.int64())

    @F.arrow_udf("long")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for size, segment in batches:
            yield pa.array([stream.count_kept(seed, s, k, numbers(s)) for s, k in zip(size.to_pylist(), segment.to_pylist(), strict=True)], pa.int64())

    several = materialized(sizes.withColumn("segments", how_many("size")).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1))))
    # only what follows another segment must know how much that one gives
    counted = dealt(several.where("segment < segments - 1"), "size", "segment").withColumn("kept", kept("size", "segment"))
    table = counted.union(several.where("segment = segments - 1").withColumn("kept", F.lit(0).cast("long")))
    before = F.sum("kept").over(Window.partitionBy("size").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return table.select("size", "segment", "segments", F.coalesce(before, F.lit(0)).alias("start"))


def block_rows(members: int) -> int:
    """Utterances of a block for frames of up to so many members. Every block draws the whole stream, so there should be no more blocks than memory asks for."""
    return max(BLOCK, BLOCK * MEMBERS // max(1, members))


def resampled_sums(rows: DataFrame, n: int = RESAMPLES, seed: int = SEED, block: int | None = None, numbers=stream.segment_numbers) -> DataFrame:
    """(frame, member, begin, e, r): sums over the resamples from `begin` on, for rows of frame, member, o (order), k (order of repeats), e (errors) and r (lengths).

    All members of a frame must have as many rows. What a task holds is bounded by `block` rows for each member, `block_rows` of the largest frame if None.
    `numbers` tells how many numbers of the generator a segment has for a frame of a size. Rows of one frame and member that
    tell of the same resample add up; there are some for each segment, and where sums over blocks were added already, one.
    """
    numbered, most, members = _numbered(rows)
    block = block or block_rows(members)
    values = F.struct("pos", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("e", "r")))
    blocks = numbered.groupBy("frame", "member", "size", F.expr(f"pos div {block}").alias("block")).agg(F.array_sort(F.collect_list(values)).alias("x"))
    blocks = blocks.select("frame", "member", "size", "block", F.col("x.pos")[0].alias("low"), F.col("x.e").alias("e"), F.col("x.r").alias("r"))
    if most and stream.segments(n * most, most, numbers(most)) == 1:  # then smaller frames have one segment, too
        met = blocks.selectExpr("*", "0L AS segment", "1L AS segments", "0L AS start")
    else:
        units = materialized(_segment_table(numbered.select("size").distinct(), n, seed, numbers))
        met = blocks.join(F.broadcast(units) if units.count() <= MAX_SENT else units, "size")

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, segment, segments, start = (int(pdf[c].iloc[0]) for c in ("size", "segment", "segments", "start"))
        pdf = pdf.sort_values("member")
        low, members = int(pdf["low"].iloc[0]), list(pdf["member"])
        table = np.stack([x for each in zip(pdf["e"], pdf["r"], strict=True) for x in each], axis=1)
        wide, begin = len(table), start // size
        sums = np.zeros((n - begin, 2 * len(members)))
        for idx in stream.draw(seed, size, segment, numbers(size), segment == segments - 1, n * size - start):
            if len(idx):
                first, last = start // size, (start + len(idx) - 1) // size
                ends = np.concatenate(([start], np.arange(first + 1, last + 1) * size, [start + len(idx)]))
                sums[first - begin : last - begin + 1] += _counts(idx, ends - start, low, wide, size) @ table
                start = int(ends[-1])
        end = -(-start // size) - begin
        return pd.DataFrame([[key[0], name, begin, sums[:end, 2 * i], sums[:end, 2 * i + 1]] for i, name in enumerate(members) if end > 0], columns=["frame", "member", "begin", "e", "r"])

    # rows are few and drawing is long: partitions by number, which are not merged for want of bytes
    drawn = dealt(met, "frame", "block", "segment").groupBy("frame", "block", "segment").applyInPandas(draw, "frame string, member string, begin long, e array<double>, r array<double>")
    if most <= block:
        return drawn
    # as many rows as there are blocks tell of a resample: they are added before anything is gathered
    each = drawn.select("frame", "member", "begin", F.explode(F.arrays_zip("e", "r", F.sequence(F.lit(0), F.size("e") - 1).alias("i"))).alias("x"))
    each = each.groupBy("frame", "member", (F.col("begin") + F.col("x.i")).alias("begin")).agg(F.sum("x.e").alias("e"), F.sum("x.r").alias("r"))
    return each.select("frame", "member", "begin", F.array("e").alias("e"), F.array("r").alias("r"))


def _vectors(sums: DataFrame, n: int) -> DataFrame:
    """(frame, member, rates): one list of n resampled rates, in the order of the resamples."""

    @F.arrow_udf("array<double>")
    def rates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for parts in column:
                total = np.zeros((2, n))
                for begin, *columns in zip(*(parts.values.field(k) for k in ("begin", "e", "r")), strict=True):
                    for row, x in zip(total, columns, strict=True):
                        row[begin.as_py() : begin.as_py() + len(x)] += x.values.to_numpy(zero_copy_only=False)
                out.append(_rates(*total))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * n, pa.int32()), pa.array(np.concatenate([np.array([]), *out])))

    return sums.groupBy("frame", "member").agg(F.collect_list(F.struct("begin", "e", "r")).alias("x")).select("frame", "member", rates("x").alias("rates"))


def _intervals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bounds of each list of rates."""
    kind = pa.struct([("lo", pa.float64()), ("hi", pa.float64())])
    for column in batches:
        yield pa.array([dict(zip(("lo", "hi"), _bounds(x.values.to_numpy()))) for x in column], kind)


def _interval(rates: str) -> Column:
    return F.arrow_udf(_intervals, "struct<lo:double,hi:double>")(rates)


def _frame(keys: list[str]) -> Column:
    """One text for the values of `keys`, nulls told apart."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def cell_intervals(rows: DataFrame, keys: list[str], errors: str = "errors", lengths: str = "ref_len", order: str = "utt_id", n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """keys, lo and hi for every cell of per-utterance rows. Rows of one utterance id are taken by their errors and lengths. No rows, no cells."""
    each = rows.select(*keys, _frame(keys).alias("frame"), F.lit("").alias("member"), F.col(order).alias("o"), F.struct(F.col(errors).cast("double"), F.col(lengths).cast("double")).alias("k"), F.col(errors).alias("e"), F.col(lengths).alias("r"))
    each = materialized(each)  # it is read three times, and what made it may be long
    # cells of as many rows have the same resamples: some of them make up a frame, so that these are drawn once for all
    cells = each.groupBy(*keys, "frame").agg(F.count("*").alias("size")).withColumn("no", F.row_number().over(Window.partitionBy("size").orderBy("frame")))
    cells = materialized(cells.select(*keys, F.col("frame").alias("member"), F.concat_ws("/", "size", F.floor((F.col("no") - 1) / MEMBERS)).alias("frame")))
    each = each.drop(*keys, "member").withColumnRenamed("frame", "member").join(cells.select("member", "frame"), "member")
    made = _vectors(resampled_sums(each, n, seed), n).select("member", _interval("rates").alias("i"))
    return cells.join(made, "member").select(*keys, "i.lo", "i.hi")


def _standing(rows: DataFrame) -> DataFrame:
    """(group, engine, rate): the rate of each engine over all its rows."""
    e, r = F.sum("e"), F.sum("r")
    rate = F.when(r != 0, e / F.when(r != 0, r)).otherwise(F.when(e > 0, 1.0).otherwise(0.0))
    return rows.groupBy("group", "engine").agg(rate.cast("double").alias("rate"))


def _pairs(standing: DataFrame) -> DataFrame:
    """(group, worse, better) of every two engines of a group."""
    one, two = (standing.select("group", F.col("engine").alias(name), F.col("rate").alias(f"{name}_rate")) for name in ("worse", "better"))
    return one.join(two, "group").where("struct(worse_rate, worse) > struct(better_rate, better)").select("group", "worse", "better")


def _compared(rows: DataFrame, by: list[str], engine: str, errors: str, lengths: str, order: str, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(group, engine, rate) of every engine, and (group, worse, better, lo, hi) of every two engines that have utterances in common.

    Pairs that have the same utterances in common make up a frame, so that these are laid out and resampled once for all of them.
    Which ones they are is told by a digest that does not depend on their order, added up over the sets of engines that utterances have.
    """
    each = rows.select(_frame(by).alias("group"), F.col(engine).alias("engine"), F.col(order).alias("o"), F.col(errors).alias("e"), F.col(lengths).alias("r"))
    each = materialized(each.withColumn("k", F.row_number().over(Window.partitionBy("group", "engine", "o").orderBy("e", "r"))))
    standing = materialized(_standing(each))
    utterances = each.groupBy("group", "o", "k").agg(F.array_sort(F.collect_list(F.struct("engine", "e", "r"))).alias("v"))
    utterances = materialized(utterances.withColumn("has", F.col("v.engine")))
    name = F.concat_ws("/", F.coalesce(F.col("o").cast("string"), F.lit("")), "k")
    digests = [F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64("o", "k"), F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10))]
    sets = materialized(utterances.groupBy("group", "has").agg(F.count("*").alias("c"), *(d.alias(f"h{i}") for i, d in enumerate(digests))))
    both = F.array_contains("has", F.col("worse")) & F.array_contains("has", F.col("better"))
    pairs = _pairs(standing).join(sets, "group").where(both).groupBy("group", "worse", "better").agg(*(F.sum(c).alias(c) for c in ("c", "h0", "h1")))
    pairs = materialized(pairs.select("group", "worse", "better", F.md5(F.to_json(F.struct("group", "c", "h0", "h1")).cast("binary")).alias("frame")))
    sides = pairs.select("frame", "group", F.explode(F.array("worse", "better")).alias("member")).distinct()
    frames = pairs.groupBy("frame", "group").agg(F.min(F.struct("worse", "better")).alias("p")).select("frame", "group", "p.worse", "p.better")
    frames = frames.join(sides.groupBy("frame").agg(F.collect_set("member").alias("members")), "frame")
    # which of an utterance's engines go into a frame is found once for a set, by their places in it
    inside = frames.join(sets, "group").where(both).withColumn("at", F.filter(F.sequence(F.lit(1), F.size("has")), lambda i: F.array_contains(F.col("members"), F.element_at("has", i))))
    inside = materialized(inside.select("group", "has", "frame", "at"))
    met = utterances.join(F.broadcast(inside) if inside.count() <= MAX_SENT // 10 else inside, ["group", "has"])
    met = met.select("frame", "o", "k", F.explode(F.transform("at", lambda i: F.element_at("v", i))).alias("v"))
    shared = met.select("frame", F.col("v.engine").alias("member"), "o", "k", "v.e", "v.r")
    places = sides.join(standing.select("group", F.col("engine").alias("member"), "rate"), ["group", "member"])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rate", "member"])
        found = [(group, x, r) for group, x, r in zip(pdf["group"], pdf["member"], pdf["rates"], strict=True)]
        out = [[key[0], group, worse, better, *_bounds(x - y)] for i, (group, worse, x) in enumerate(found) for _, better, y in found[:i]]
        return pd.DataFrame(out, columns=["frame", "group", "worse", "better", "lo", "hi"])

    # a task holds the vectors of a frame's engines, n numbers each, and no utterances
    vectors = _vectors(resampled_sums(shared, n, seed), n).join(places, ["frame", "member"])
    made = vectors.groupBy("frame").applyInPandas(compare, "frame string, group string, worse string, better string, lo double, hi double")
    # two engines of a frame may have more in common than what the frame is of
    return standing, made.join(pairs, ["frame", "group", "worse", "better"], "left_semi").drop("frame")


def paired_intervals(rows: DataFrame, by: list[str], engine: str = "engine", errors: str = "errors", lengths: str = "ref_len", order: str = "utt_id", n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """by, worse, better, lo, hi: the interval of the rate difference of every two engines; null where they have no utterance in common.

    Each two are resampled over what they have in common, all that have the same in common at once; a repeated utterance meets as many of its repeats as the other engine has. Engines are
    ranked by their rate over all their own rows, then by name.
    """
    standing, found = _compared(rows, by, engine, errors, lengths, order, n, seed)
    pairs = _pairs(standing)
    groups = rows.select(*by).distinct().withColumn("group", _frame(by))
    return groups.join(pairs.join(found, ["group", "worse", "better"], "left"), "group").select(*by, "worse", "better", "lo", "hi")


def tie_group_table(rows: DataFrame, by: list[str], engine: str = "engine", errors: str = "errors", lengths: str = "ref_len", order: str = "utt_id", n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """by, tie_groups: arrays of engines, each compared with the leader of the tier at hand only. A task holds the intervals of one group's pairs."""
    standing, found = _compared(rows, by, engine, errors, lengths, order, n, seed)
    ranked = standing.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("rate", "engine"))).alias("x")).select("group", F.col("x.engine").alias("ranked"))
    held = found.where("lo <= 0 and hi >= 0").groupBy("group").agg(F.collect_list(F.array("better", "worse")).alias("tied"))

    @F.arrow_udf("array<array<string>>")
    def fold(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, ties in batches:
            out = []
            for order_, held_ in zip(names.to_pylist(), ties.to_pylist(), strict=True):
                known = {tuple(p) for p in held_ or ()}
                out.append(fold_tiers(order_, lambda leader, name, known=known: (leader, name) in known))
            yield pa.array(out, pa.list_(pa.list_(pa.string())))

    groups = rows.select(*by).distinct().withColumn("group", _frame(by))
    return groups.join(ranked.join(held, "group", "left").select("group", fold("ranked", "tied").alias("tie_groups")), "group").select(*by, "tie_groups")
