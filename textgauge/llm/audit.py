"""Filter interaction audit over the lattice of applied filters.

Which documents a filter removes depends on the filters before it, but only on which ones, not on
their order. Each document has a mask of the filters it fails; documents are counted by part and
mask (at most 2^k rows a part), and every count contributes to the k 2^(k-1) edges (set applied
already, next filter) of the lattice: 80 for five filters. An order of the filters is a path from the empty
set upward, so the k! k steps of all orders are a join of a fixed table of steps with the edges.
Documents are read once, whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders are listed in full, so filters are few.
MAX_FILTERS = 6
#: Rows without an id are dealt over this many keys where documents meet their labels.
SALTS = 64
_SPACE, _TRIMMED = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\x0c\r"


def text_filters(text: str) -> dict[str, Column]:
    """Failure conditions A to D over a whole text, null read as empty: few words, few different words, many capitals, symbols."""
    t = F.coalesce(F.col(text), F.lit(""))
    inner = F.btrim(t, F.lit(_TRIMMED))
    words = F.when(inner != "", F.split(inner, _SPACE)).otherwise(F.array().cast("array<string>"))
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    return {"A": n < 200, "B": 100 * different < 50 * n, "C": 100 * capitals > 3 * F.length(t).cast("long"), "D": t.rlike("[#$%&*|]")}


def _flag(name: str) -> Column:
    return F.coalesce(F.max(F.col(name) == 1), F.lit(False))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = "E", id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit i for the i-th name of `filters`, then `copies`.

    `copies` fails a text that equals the text of any smaller id, in whatever part. Null and empty texts are equal; a null
    part is ''. A row without an id fails no copy test, makes no other fail it, and has no label. Repeated rows count
    as often as they come. A document is good (toxic) if any row of `labels` says so.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))
    base = base.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0))
    told = labels.groupBy(F.col(id_col).alias("id")).agg(_flag("quality").alias("good"), _flag("toxic").alias("toxic")).where("id is not null and (good or toxic)").withColumn("salt", F.lit(0).cast("long"))
    # one row for each id, text and part, so that the smallest id of a text brings how often it comes
    each = base.join(told, ["id", "salt"], "left").na.fill(False, ["good", "toxic"])
    each = each.groupBy("id", "salt", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("c"))
    if copies is None:
        cells = each.select("part", "mask", "good", "toxic", F.col("c").alias("n"))
    else:
        # a text of very many rows is combined before it is shuffled: a row for each part and label it has
        named = F.when(F.col("id").isNotNull(), F.struct("id", "c"))
        cells = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("c").alias("n"), F.min(named).alias("low"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("unnamed"))
        cells = cells.withColumn("first", F.min("low.id").over(Window.partitionBy("digest")))
        once = F.col("unnamed") + F.when(F.col("low.id") == F.col("first"), F.col("low.c")).otherwise(0)
        split = F.array(F.struct(F.col("mask"), once.alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(filters)).alias("mask"), (F.col("n") - once).alias("n")))
        cells = cells.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.*").where("n > 0")
    counted = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    return cells.groupBy("part", "mask").agg(*counted)


def lattice_edges(masks: DataFrame, k: int) -> DataFrame:
    """(part, applied, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row an edge of the lattice and part, zeros included.

    `applied` is the mask of the filters before, `bit` that of the next one. shapley is the removed of that
    filter over all orders: an edge with s filters before lies on s! (k - 1 - s)! of them.
    """
    edges = [(s, 1 << f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in edges)))
    rows = masks.select("*", edge.alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0

    def total(c: str, condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col(c)).otherwise(0)).alias(name)

    sums = rows.groupBy("part", "applied", "bit").agg(
        total("n", ~before & ~fails, "kept"), total("n", ~before & fails, "removed"), total("n", before & fails, "redundant"), total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", ~before & fails, "good_lost"), total("toxic", ~before & fails, "toxic_lost"),
    )
    orders = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), F.bit_count("applied") + 1)
    return sums.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "bit")))


def order_steps(names: list[str]) -> list[tuple[str, int, str, int, int]]:
    """(order, step, filter, applied, bit) of every step of every order."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    return [("".join(order), at + 1, name, sum(bit[x] for x in order[:at]), bit[name]) for order in permutations(names) for at, name in enumerate(order)]


def audit_orders(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part, order of the filters and step.

    `filters`: one-letter names to failure conditions that are never null (default: `text_filters`). No documents, no rows. See `mask_counts`
    for nulls, repeats and labels.
    """
    filters = text_filters(text) if filters is None else filters
    names = [*filters, *([copies] if copies else [])]
    if not names or len(names) > MAX_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MAX_FILTERS} filters of different names are audited")
    edges = lattice_edges(mask_counts(docs, labels, filters, copies, id_col, text, part), len(names))
    # at most 6! x 6 rows, whatever the data
    steps = docs.sparkSession.createDataFrame(order_steps(names), "filter_order string, step int, filter string, applied int, bit int")
    out = edges.join(F.broadcast(steps), ["applied", "bit"])
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
