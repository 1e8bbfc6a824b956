"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors u are coded as s * q with integers q in -127..127. With e = |u - s q| known for each
vector, |u.v - s t (q.r)| <= e_u + |s q| e_v. A tile product gives all q.r of two tiles exactly
(single-precision sums of such integers are exact up to 1,024 components, longer vectors are summed
in parts), and so an upper and a lower bound of each cosine: pairs whose upper bound is under the
threshold are done, pairs whose lower bound reaches it are links, and only those between are
computed in double precision.

Equal vectors are folded first. Vectors are laid into cells by their nearest pivot, and cells cut
into tiles; the tiles of two cells whose pivots are further apart than their radii and the threshold's
angle hold no link and never meet. That is settled for pairs of pivots, whose number is bounded, at
every number of vectors. Vectors without such structure make every pair of tiles meet: that is
quadratic work, with reads of each tile once for each other one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import low_hash, wide_share, written
from textgauge.llm.components import connected_components

#: Bytes of a tile's vectors as they are stored, and tiles that a table is cut into at least, so that there is work for many tasks.
#: Each tile is sent to each other tile it meets, so larger ones are sent fewer times.
TILE_BYTES, LEAST_TILES = 16 << 20, 12
#: Pivots at most; they are broadcast (1,024 of 1,024 doubles: 8 MB), and so is which of them meet.
MAX_PIVOTS = 1024
#: Allowance for rounding in the bounds, far above single precision's.
SLACK = 4e-6
ROWS = 512


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales and the length of each vector's quantisation error."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.sqrt(((u - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = None
    for at in range(0, a.shape[1], 1024):
        part = a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def compare_tiles(a: dict, b: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Weighted link counts and component labels over the rows of a, then b; and pairs recomputed.

    Each side: u (unit vectors), codes, scale, error, weight. b None: a with itself.
    """
    same = b is None
    b = a if same else b
    n, m = len(a["u"]), len(b["u"])
    off = 0 if same else n
    links, label, recomputed = np.zeros(off + m), np.arange(off + m), 0
    far = b["error"] * (1 + a["error"].max(initial=0)) + SLACK
    bcodes = b["codes"].astype(np.float32) if b["codes"].shape[1] <= 1024 else b["codes"]
    for at in range(0, n, ROWS):
        rows = slice(at, min(n, at + ROWS))
        s = a["codes"][rows].astype(np.float32) @ bcodes.T if bcodes.dtype == np.float32 else _products(a["codes"][rows], bcodes)
        s *= b["scale"].astype(s.dtype)
        s *= a["scale"][rows, None].astype(s.dtype)
        err = a["error"][rows, None]
        possible = s + far.astype(s.dtype) >= (threshold - err).astype(s.dtype)
        if same:
            possible &= np.arange(m) > np.arange(rows.start, rows.stop)[:, None]
        i, j = np.nonzero(possible)
        if not len(i):
            continue
        linked = s[i, j] - far[j] - err[i, 0] >= threshold
        for part in range(0, len(i), 1 << 16):
            x = np.flatnonzero(~linked[part : part + (1 << 16)]) + part
            recomputed += len(x)
            linked[x] = np.einsum("ij,ij->i", a["u"][i[x] + at], b["u"][j[x]]) >= threshold
        i, j = i[linked] + at, j[linked]
        np.add.at(links, i, b["weight"][j])
        np.add.at(links, j + off, a["weight"][i])
        cuts = np.flatnonzero(np.diff(i)) + 1
        for row, mates in zip(i[np.concatenate(([0], cuts))] if len(i) else [], np.split(j, cuts), strict=False):
            met = np.append(label[mates + off], label[row])
            low = met.min()
            if met.max() != low:
                label[np.isin(label, np.unique(met))] = low
    return links, label, recomputed


def _valid(column: str) -> F.Column:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def tile_rows(n: int, dim: int, width: int) -> int:
    """Vectors in a tile, about."""
    return max(1, min(TILE_BYTES // (dim * width), max(512, -(-n // LEAST_TILES))))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, tile: int | None = None) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    n_links counts the other rows whose cosine reaches `threshold` (at most 1), component_id is the
    smallest id reachable. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing; neither do rows without an id, whose component_id is null.
    Vectors of different lengths do not link. Equal vectors link, whatever else the rows hold. Rows
    that share an id are vectors of their own. `tile` is the number of vectors in a tile.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(embedding).alias("v"))
    good = rows.where(F.col("id").isNotNull() & _valid("v"))
    # a number for each different vector, fixed by the files written here
    folded = good.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n")).select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("rep"))
    folded = written(folded, "vectors")
    kinds = {r.dim: r.n for r in folded.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    width = 4 if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else 8
    parts = [_links(folded.where(F.col("dim") == d), n, d, threshold, tile or tile_rows(n, d, width)) for d, n in sorted(kinds.items())]
    if not parts:
        found = spark.createDataFrame([], "rep bigint, links bigint, root bigint")
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
    found = written(found, "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    known = folded.join(counts, "rep", "left").join(nodes, F.col("rep") == F.col("node"), "left")
    known = known.select("v", "low", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("links"))
    names = known.groupBy("component").agg(F.min("low").alias("name"))
    linked = good.join(known.join(names, "component"), "v").select("id", F.col("links").alias("n_links"), F.col("name").alias("component_id"))
    alone = rows.where(~(F.col("id").isNotNull() & _valid("v"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.union(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(folded: DataFrame, n: int, dim: int, threshold: float, tile: int) -> DataFrame:
    """(rep, links, root): for each pair of tiles that may hold links, counts and a root to hang on."""
    n_pivots = max(1, min(MAX_PIVOTS, n // tile))
    few = low_hash(F.col("rep"), F.lit(wide_share(n_pivots, n)))
    first = folded.where(few).orderBy(F.pmod(F.xxhash64("rep"), F.lit(1 << 40)), "rep").limit(n_pivots).select("v").collect()  # a bounded sample; it only steers the layout
    pivots = unit(np.array([r.v for r in first]))
    kind = folded.schema["v"].dataType.elementType.simpleString()
    raw = np.float32 if kind == "float" else np.float64

    def place(batches):
        for pdf in batches:
            near = unit(np.stack(pdf["v"].to_numpy())) @ pivots.T if len(pdf) else np.zeros((0, len(pivots)))
            yield pd.DataFrame({"rep": pdf["rep"], "n": pdf["n"], "v": pdf["v"], "pivot": near.argmax(axis=1), "near": near.max(axis=1)})

    placed = written(folded.select("rep", "n", "v").mapInPandas(place, f"rep bigint, n bigint, v array<{kind}>, pivot int, near double"), "placed")
    cells = {int(r.pivot): r for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()}  # MAX_PIVOTS rows
    radius = np.full(len(pivots), -np.inf)  # a cell without vectors meets nothing
    for p, r in cells.items():
        radius[p] = np.arccos(np.clip(r.near, -1, 1)) + 1e-6
    ways = [max(1, -(-cells[p].n // tile)) if p in cells else 0 for p in range(len(pivots))]
    meets = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) <= radius[:, None] + radius + np.arccos(min(1.0, threshold)) + 1e-6
    partners = [np.flatnonzero(row & np.isfinite(radius)).tolist() for row in meets]
    spark = folded.sparkSession
    cell_table = spark.createDataFrame([(p, ways[p], [(q, ways[q]) for q in partners[p]]) for p in cells], "pivot int, ways int, partners array<struct<pivot:int,ways:int>>")
    tiled = placed.join(F.broadcast(cell_table.select("pivot", "ways")), "pivot").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("ways")).cast("int"))

    def pack(key, pdf):
        pdf = pdf.sort_values("rep")
        return pd.DataFrame({"pivot": [key[0]], "part": [key[1]], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "weights": [pdf["n"].to_numpy(np.int64).tobytes()], "raw": [np.stack(pdf["v"].to_numpy()).astype(raw).tobytes()]})

    tiles = written(tiled.groupBy("pivot", "part").applyInPandas(pack, "pivot int, part int, ids binary, weights binary, raw binary"), "tiles")
    name = lambda pivot, part: F.shiftleft(pivot.cast("bigint"), 32) + part
    sent = tiles.join(F.broadcast(cell_table.select("pivot", "partners")), "pivot").select(name(F.col("pivot"), F.col("part")).alias("tile"), "ids", "weights", "raw", F.explode("partners").alias("p"))
    sent = sent.select("tile", "ids", "weights", "raw", "p", F.explode(F.sequence(F.lit(0), F.col("p.ways") - 1)).alias("other_part"))
    sent = sent.withColumn("other", name(F.col("p.pivot"), F.col("other_part"))).drop("p", "other_part")
    sent = sent.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})

    def side(row) -> dict:
        v = np.frombuffer(row["raw"], raw).reshape(-1, dim)
        u = unit(v)
        codes, scale, error = quantise(u)
        return {"u": u, "codes": codes, "scale": scale, "error": error, "weight": np.frombuffer(row["weights"], np.int64).astype(np.float64), "ids": np.frombuffer(row["ids"], np.int64)}

    def meet(key, pdf):
        sides = [side(r) for r in pdf.sort_values("tile").to_dict("records")]
        if key[0] != key[1] and len(sides) < 2:
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        links, label, _ = compare_tiles(sides[0], sides[1] if len(sides) > 1 else None, threshold)
        ids = np.concatenate([s["ids"] for s in sides])
        has = links > 0
        return pd.DataFrame({"rep": ids[has], "links": links[has].astype(np.int64), "root": ids[label[has]]})

    return sent.groupBy("lo", "hi").applyInPandas(meet, "rep bigint, links bigint, root bigint")
