"""Mixing sources to target weights.

The words of each source, in a pseudorandom order of its documents, are packed into blocks of a
fixed number of words. Each output shard draws how many of its slots each source fills from a
multinomial over what the sources still owe; a source's i-th slot takes the block at which a keyed
permutation of its block numbers sends i modulo their number, with a new permutation for each pass.
Slots and blocks then meet in a join by (source, block).

The shards are divided into ranges, about as many as a range has shards: the driver draws what each
range takes of each source, and one task a range draws what its shards take. Their number is not
bounded.

Offsets in a source come from three levels of running sums (within a bucket of some thousand
documents, over the buckets of a group, over the groups), so that no task holds a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import sliced, text_udf, WORD, written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Numbers of slots drawn on the driver at most; they settle into how many ranges the shards are divided there.
MAX_DRAWN = 1_000_000
#: Sources whose sums come to the driver, at most; more are refused, none is dropped.
MAX_SOURCES = 100_000
BUCKET_DOCS = 2_000
GROUP_BUCKETS = 1024
SEED = 20_240_607


def fill_targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> list[float]:
    """Shares of the whole by repeating weights; none above `most` times its size, the excess reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, capped = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = sum(sizes) - sum(most * sizes[i] for i in capped)
        weight = sum(w[i] for i in free)
        for i in free:
            target[i] = left * w[i] / weight
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return [float(t) for t in target]
        for i in over:
            target[i] = float(most * sizes[i])
        capped.update(over)


def draw_shards(slots: list[int], rooms: list[int], seed: int | list[int] = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot of the source, number of slots) for shards of `rooms` slots; a source's slots add up to what it owes."""
    rng, left, out = np.random.default_rng(seed), np.array(slots, np.int64), []
    given = np.zeros_like(left)
    for shard, room in enumerate(rooms):
        while room > 0:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
            for s in np.flatnonzero(drawn).tolist():
                out.append((shard, s, int(given[s]), int(drawn[s])))
            given += drawn
            left -= drawn
            room -= int(drawn.sum())
    return out


def _mixed_bits(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed 64-bit mixing function (the finaliser of splitmix64)."""
    x = (x + key) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where keyed permutations of 0..n-1 send i: four Feistel rounds, walking on while outside."""
    i, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.arange(len(i))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k, x = half[todo], mask[todo], key[todo], out[todo]
            left, right = x >> h, x & m
            for turn in range(4):
                left, right = right, left ^ (_mixed_bits(right, k + np.uint64(turn * 0x9E3779B9)) & m)
            out[todo] = left << h | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _permute(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for source, turn, at, n in batches:
        key = _mixed_bits(source.to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(32) | turn.to_numpy(zero_copy_only=False).astype(np.uint64), np.uint64(SEED))
        yield pa.array(permuted(at.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), key), pa.int64())


class Mix:
    """The tables of a mix.

    docs: id, source, tie, source_no, size, source_size, target, start (the place of the document's
    first word in its source). slots: shard, source_no, slot, turn, block. pieces: source_no, block,
    start, first (word of the document), words.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, block_words: int = BLOCK_WORDS, seed: int = SEED):
        spark = docs.sparkSession
        words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
        sized = written(docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text)).alias("tie"), words.alias("size")), "sizes")
        per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        rows = per.limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        rows.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r.size for r in rows]
        targets = fill_targets(sizes, weights, most)
        blocks = [-(-s // block_words) for s in sizes]
        # rounded by the words an average block of the source holds, as its last one may be short
        slots = [min(most * b, round(t * b / s)) if s else 0 for t, b, s in zip(targets, blocks, sizes, strict=True)]
        shards = -(-sum(slots) // SHARD_SLOTS)
        ranges = max(1, min(math.isqrt(max(0, shards - 1)) + 1, MAX_DRAWN // max(1, len(rows))))
        room = -(-shards // ranges) * SHARD_SLOTS
        rooms = [min(room, sum(slots) - at) for at in range(0, sum(slots), room or 1)]
        known = [(r.source, i, s, t, b) for i, (r, s, t, b) in enumerate(zip(rows, sizes, targets, blocks, strict=True))]
        sources = F.broadcast(spark.createDataFrame(known, "source string, source_no int, source_size bigint, target double, blocks bigint"))  # at most MAX_SOURCES rows
        buckets = max(1, -(-sum(r.n for r in rows) // BUCKET_DOCS))
        keyed = sized.join(sources, sized.source.eqNullSafe(sources.source)).select("id", sized.source, "tie", "size", "source_no", "source_size", "target", F.pmod(F.xxhash64("id", "tie"), F.lit(buckets)).alias("bucket"))
        sums = keyed.groupBy("source_no", "bucket").agg(F.sum("size").alias("of_bucket")).withColumn("group", F.expr(f"bucket div {GROUP_BUCKETS}"))
        earlier = lambda value, order, *by: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = sums.groupBy("source_no", "group").agg(F.sum("of_bucket").alias("of_group"))
        groups = groups.select("source_no", "group", earlier("of_group", "group", "source_no").alias("of_groups"))
        sums = sums.withColumn("of_buckets", earlier("of_bucket", "bucket", "source_no", "group")).join(groups, ["source_no", "group"])
        sums = sums.select("source_no", "bucket", (F.col("of_groups") + F.col("of_buckets")).alias("before"))
        inside = F.coalesce(F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy(F.xxhash64("tie", "id"), "id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = keyed.withColumn("inside", inside).join(sums, ["source_no", "bucket"])
        self.docs = written(placed.select("id", "source", "tie", "source_no", "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("start")), "placed")
        drawn = spark.createDataFrame(draw_shards(slots, rooms, seed), "range int, source_no int, first bigint, n bigint")

        def of_range(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, number = pdf.sort_values("source_no"), int(key[0])
            total = int(pdf["n"].sum())
            got = draw_shards(pdf["n"].tolist(), [min(SHARD_SLOTS, total - at) for at in range(0, total, SHARD_SLOTS)], [seed, number])
            shard, which, first, n = (np.array(c, np.int64) for c in zip(*got, strict=True))
            source, base = pdf["source_no"].to_numpy()[which], pdf["first"].to_numpy()[which]
            return pd.DataFrame({"shard": shard + number * (room // SHARD_SLOTS), "source_no": source, "first": base + first, "n": n})

        plan = drawn.groupBy("range").applyInPandas(of_range, "shard bigint, source_no int, first bigint, n bigint")
        step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(SHARD_SLOTS).cast("bigint"))).alias("part")
        plan = plan.join(sources.select("source_no", "blocks"), "source_no").select("shard", "source_no", "blocks", "first", "n", step)
        plan = plan.repartition(max(8, -(-sum(slots) // 500_000)), "shard", "part")
        each = F.explode(F.sequence(F.col("part"), F.least(F.col("part") + SHARD_SLOTS, F.col("n")) - 1)).alias("i")
        plan = plan.select("shard", "source_no", "blocks", "first", each).withColumn("slot", F.col("first") + F.col("i"))
        plan = plan.withColumns({"turn": F.expr("slot div blocks"), "at": F.expr("slot % blocks")})
        self.slots = plan.select("shard", "source_no", "slot", "turn", text_udf(_permute, "bigint")("source_no", "turn", "at", "blocks").alias("block"))
        b = F.lit(block_words).cast("bigint")
        held = F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block")
        cut = self.docs.where("size > 0").select("source_no", "start", "size", held)
        first = F.greatest(F.col("block") * b, F.col("start"))
        last = F.least((F.col("block") + 1) * b, F.col("start") + F.col("size"))
        self.pieces = cut.select("source_no", "block", "start", (first - F.col("start")).alias("first"), (last - first).alias("words"))


def mix_report(mix: Mix, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken (words taken, repeats counted)."""
    uses = mix.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    taken = mix.pieces.join(uses.hint("merge"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # a document without words shares its start with the next one, so it must not take part in the join
    some = mix.docs.where("size > 0").join(taken.hint("merge"), ["source_no", "start"], "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    none = mix.docs.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    both = some.union(none)
    return both.select(F.col("id").alias(id_col), *both.columns[1:])


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    import re

    word = re.compile(WORD)
    for texts, spans in sliced(batches):
        out = []
        for text, span in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            places = [m.span() for m in word.finditer(text)]
            merged: list[list[int]] = []
            for first, n in sorted((s["first"], s["words"]) for s in span):
                if merged and merged[-1][1] == first:
                    merged[-1][1] = first + n
                else:
                    merged.append([first, first + n])
            if merged == [[0, len(places)]]:
                out.append(text)
            else:
                out.append("\n".join(text[places[a][0] : places[b - 1][1]] for a, b in merged))
        yield pa.array(out, pa.string())


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as documents, with the columns of `docs`: one row for each pass that takes words of a document.

    A pass that takes all words gives the text unchanged; one that takes some blocks gives their
    words with the white space between them, and a line break where words are left out. Documents
    of which nothing is taken (those without words among them) have no row. Lengths are set anew in
    a column n_chars, if there is one. Repeated rows are documents of their own.
    """
    mix = Mix(docs, id_col, text, source, **how)
    met = mix.slots.select("source_no", "turn", "block").join(mix.pieces.hint("merge"), ["source_no", "block"])
    passes = met.groupBy("source_no", "start", "turn").agg(F.collect_list(F.struct("first", "words")).alias("__spans"))
    passes = passes.join(mix.docs.where("size > 0").hint("merge"), ["source_no", "start"]).select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), "__spans")
    keyed = docs.withColumn("__text_tie", F.xxhash64(F.col(text)))
    repeats = mix.docs.where("size > 0").groupBy("id", "source", "tie").agg(F.count("*").alias("n")).where("n > 1")
    if not repeats.isEmpty():  # the rows of a repeated document share its passes
        keyed = keyed.dropDuplicates([id_col, source, "__text_tie"])
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source).cast("string").eqNullSafe(F.col("__source")) & (F.col("__text_tie") == F.col("__tie"))
    out = keyed.join(passes.hint("merge"), same).withColumn(text, text_udf(_cut, "string")(F.col(text), F.col("__spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
