"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint of 64 bits is cut into `blocks` blocks. Two fingerprints at distance d or less
agree on at least `blocks - d` whole blocks, so each is filed once under every choice of that
many blocks, and only fingerprints filed under the same key are compared.

Exact copies share a fingerprint and are folded before anything is joined. A key under which
more than `hot` different fingerprints are filed is not joined with itself: there each
fingerprint is sent to the patterns one flipped bit away (flipping bits outside the key only);
two fingerprints are at distance two or less exactly if they meet at such a pattern. That takes
a fixed number of rows a fingerprint, and as at most 65 fingerprints can meet at one pattern,
no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import discard, free_shuffles, low_hash, sliced, text_udf, wide_share, written
from textgauge.llm.components import connected_components

SEED = 42
#: Shingles whose bits are unpacked at once; bounds the memory a very long text takes.
STEP = 1 << 16


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; sums of 255 rows fit in a byte, which adds up fastest."""
    out = np.zeros(64, np.int64)
    bits = _bits(hashes)
    for at in range(0, len(bits), 255):
        out += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text as an unsigned 64-bit number; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        ones += _ones(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)], np.uint64))
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in sliced(batches):
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.array(values.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """`docs` with the fingerprint of `text` as a signed long in column `to` (replaced, if there is one); null and empty texts get 0."""
    return docs.withColumn(to, text_udf(_fingerprints, "bigint")(F.col(text)))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask of the compared bits for every choice of `blocks - distance` blocks."""
    if blocks <= distance:
        raise ValueError("there must be more blocks than differing bits")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def fingerprint_links(fps: DataFrame, fp: str = "fp", distance: int = 2, blocks: int = 5, hot: int = 256) -> DataFrame:
    """Edges (src, dst) between different fingerprints, spanning every pair within `distance` bits.

    Keys with at most `hot` fingerprints give every pair as an edge; hot keys give stars over the
    shared patterns, which connect the same fingerprints. The way of hot keys holds for a distance
    of at most 2; for more, all keys are joined.
    """
    masks = block_masks(blocks, distance)
    filed = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(masks))))
    rows = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct().select("fp", filed.alias("f")).select("fp", "f.t", "f.key")
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(rows.join(shared, ["t", "key"]), "blocks")
    small = rows if distance > 2 else rows.where(F.col("n") <= hot)
    one, other = (small.select("t", "key", F.col("fp").alias(name)) for name in ("src", "dst"))
    close = one.join(other, ["t", "key"]).where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance))
    links = close.select("src", "dst")
    if distance > 2:
        return links.distinct()
    # each table's own bits outside its key, as single-bit patterns, with 0 for the fingerprint itself
    flips = [[0, *(_signed(1 << b) for b in range(64) if not m >> b & 1)] for m in masks]
    flip = F.explode(F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in flips)), F.col("t") + 1))
    hubs = rows.where(F.col("n") > hot).select("fp", flip.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")).distinct()
    met = hubs.groupBy("hub").agg(F.min("fp").alias("dst"), F.collect_set("fp").alias("all"))
    if distance < 2:  # meeting at a pattern means two bits at most
        met = met.where("false")
        links = one_bit(rows.where(F.col("n") > hot), flip, distance).union(links)
    stars = met.where(F.size("all") > 1).select(F.explode("all").alias("src"), "dst").where("src <> dst")
    return links.union(stars).distinct()


def one_bit(rows: DataFrame, flip: Column, distance: int) -> DataFrame:
    """Edges of hot keys for a distance of 1 or 0: the one-bit neighbours that exist."""
    if distance < 1:
        return rows.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).where("false")
    near = rows.select("fp", flip.alias("flip")).select(F.col("fp").alias("src"), F.col("fp").bitwiseXOR(F.col("flip")).alias("dst")).where("src < dst")
    return near.join(rows.select(F.col("fp").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 2, blocks: int = 5, hot: int = 256) -> DataFrame:
    """One row per input row: id_col, fp, component_id (smallest id reachable through links).

    Null and empty texts have fingerprint 0 and link like any others. Repeated rows stay rows.
    A null id takes part but never names a component unless its whole component has none.
    """
    marked = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t").select("id", "fp"), "fps")
    firsts = marked.groupBy("fp").agg(F.min("id").alias("first_id"))
    nodes = connected_components(fingerprint_links(firsts, "fp", distance, blocks, hot))
    roots = firsts.join(nodes, firsts.fp == nodes.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = roots.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: What `similar_documents` does: words a shingle, how many texts of one key are compared pair by pair, leaders that
#: spare a larger key most pairs, texts of a block (about), and the bits of a shingle's hash that texts are filed under.
WIDTH, HOT, LEADERS, BLOCK, FILED = 5, 64, 4, 128, (1 << 40) - 1
#: Sets in a block differ in size by at most LIKE, and have about HELD shingles together unless there is but one; parts in which
#: the pairs of a family's blocks are drawn.
LIKE, HELD, SALTS = 1.1, 1 << 20, 16
#: Texts counted at least for the order of prefixes, and how many of the most frequent shingles are held.
SAMPLE, COMMON = 4_000, 1 << 20
#: Bits of the map of wanted ids that spares other texts a shuffle (2 MB at any size of the table).
SLOTS = 1 << 24
#: Two long sets of similarity 0.8 differ in 19.4 bits of their 128-bit fingerprints, with a deviation of 4.1. Pairs of more
#: than FAR differing bits (six deviations on) are not compared further; sets of up to SHORT shingles are all compared.
FAR, SHORT = 44, 32


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's different five-word shingles; a shorter text is one shingle, no words are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return np.array([digest(joined, SEED)] if words else [], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - WIDTH + 1].tolist()
    hashes = np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, ends[WIDTH - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return np.unique(hashes.view(np.int64))


LINKS = "array<struct<node:bigint,other:bigint>>"


def prefix_length(n: int | Column) -> int | Column:
    """Of two sets of similarity 0.8 the larger has their first common member among its first n - ceil(0.8 n) + 1, in any order that all sets have."""
    return F.floor(n / 5).cast("int") + 1 if isinstance(n, Column) else n // 5 + 1


def index_length(n: int) -> int:
    """The smaller one, or either of two as large, has it among its first n - ceil(8 n / 9) + 1, as they share 8/9 of its members."""
    return n // 9 + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.array([], np.int64), pa.int64()))


def _key(shingles: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)


def set_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The 128-bit SimHash of a set of shingle hashes, as two longs; the second from the hashes mixed once more."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(shingles), STEP):
        one = shingles[at : at + STEP].view(np.uint64)
        two = (one ^ (one >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        ones[:64] += _ones(one)
        ones[64:] += _ones(two ^ (two >> np.uint64(29)))
    return np.packbits(2 * ones > len(shingles)).view(">u8").astype(np.uint64).view(np.int64)


def _marks(common: tuple[np.ndarray, np.ndarray]):
    def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sliced(batches):
            sets = [shingle_set(t.as_py()) for t in texts]
            keys = np.concatenate([_key(x) for x in sets]).reshape(-1, 2)
            first = _lists([prefix(x, common) & FILED for x in sets])
            prints = np.concatenate([set_fingerprint(x) for x in sets]).reshape(-1, 2)
            yield pa.StructArray.from_arrays([*(pa.array(x[:, i]) for x in (keys, prints) for i in (0, 1)), pa.array([len(x) for x in sets], pa.int32()), first], names=["k1", "k2", "f1", "f2", "n", "first"])

    return marks


def _shingle_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in sliced(batches):
        yield _lists([shingle_set(t.as_py()) for t in texts])


def _keyed_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in sliced(batches):
        sets = [shingle_set(t.as_py()) for t in texts]
        keys = np.concatenate([_key(x) for x in sets]).reshape(-1, 2)
        yield pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(sets)], names=["k1", "k2", "s"])


def _members(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    node, comp, sets = block.values.flatten()
    return node.to_numpy(), comp.to_numpy(), sets.value_lengths().to_numpy(), sets.flatten().to_numpy()


def _common(one: tuple, two: tuple) -> np.ndarray:
    """How many shingles each set of one block has in common with each of another."""
    both = np.intersect1d(one[3], two[3])
    sides = []
    for _, _, sizes, flat in (one, two):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        known = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        sides.append((np.repeat(np.arange(len(sizes)), sizes)[known], at[known], len(sizes)))
    out = np.zeros((sides[0][2], sides[1][2]), np.float32)
    for low in range(0, len(both), 4096):
        dense = []
        for row, column, n in sides:
            here = (column >= low) & (column < low + 4096)
            x = np.zeros((n, min(4096, len(both) - low)), np.float32)
            x[row[here], column[here] - low] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def block_links(one: tuple, two: tuple) -> list[tuple[int, int]]:
    """Pairs of similarity 0.8 or more between two blocks, as many as join the components that such pairs join."""
    sizes = one[2].astype(np.int64)[:, None] + two[2].astype(np.int64)[None, :]
    found = np.argwhere((9 * _common(one, two) >= 4 * sizes) & (one[1][:, None] != two[1][None, :]))
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i, j in found.tolist():
        a, b = top(int(one[1][i])), top(int(two[1][j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(one[0][i]), int(two[0][j])))
    return out


def _block_links(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("node", pa.int64()), ("other", pa.int64())]))
    for ones, twos in batches:
        yield pa.array([[{"node": a, "other": b} for a, b in block_links(_members(x), _members(y))] for x, y in zip(ones, twos, strict=True)], kind)


def common_shingles(named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, as filed, that are frequent in a sample of the texts `t`, and how often each was met there.

    They settle the order in which prefixes are taken, and so only how many texts meet, not which are alike.
    """
    share = max(1 / 8, wide_share(SAMPLE, named.count()))
    some = named.where(low_hash(F.col("id"), F.lit(share))).select(F.explode(text_udf(_shingle_sets, "array<bigint>")(F.col("t"))).alias("s"))
    counts = some.groupBy(F.col("s").bitwiseAND(FILED).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "common")
    least, left = 2, COMMON
    for n, many in sorted(((r.n, r.many) for r in counts.groupBy("n").agg(F.count("*").alias("many")).collect()), reverse=True):
        left -= many
        if left < 0:
            least = n + 1
            break
    got = counts.where(F.col("n") >= least).toArrow()
    discard(counts)
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    by = np.argsort(keys)
    return keys[by], n[by]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, as many as `prefix_length`, by one order for all sets: the rarest first, then by hash."""
    keys, n = common
    size = prefix_length(len(shingles))
    if not len(keys):
        return shingles[:size]
    own = shingles & FILED
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return shingles[np.lexsort((shingles, np.where(keys[at] == own, n[at], 0)))[:size]]


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (node, other) whose sets have a similarity of 0.8 or more."""
    one, two = sets.select("node", "n", "s"), sets.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("s").alias("t"))
    joined = pairs.join(one, "node").join(two, "other").where((5 * F.col("n") >= 4 * F.col("m")) & (5 * F.col("m") >= 4 * F.col("n")))
    return joined.where(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.col("n") + F.col("m"))).select("node", "other").distinct()


def _by_blocks(nodes: DataFrame) -> DataFrame:
    """Pairs (node, other) of sets whose 64-bit fingerprints f1 differ in two bits at most, found by `fingerprint_links`. Sets of one fingerprint meet its lowest node."""
    firsts = written(nodes.groupBy("f1").agg(F.min("node").alias("first")), "firsts")
    same = nodes.select("node", "f1").join(firsts, "f1").where("node <> first").select(F.col("first").alias("node"), F.col("node").alias("other"))
    one, two = firsts.select(F.col("f1").alias("src"), F.col("first").alias("a")), firsts.select(F.col("f1").alias("dst"), F.col("first").alias("b"))
    near = fingerprint_links(firsts, "f1").join(one, "src").join(two, "dst")
    return same.union(near.select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("other")))


def _candidates(few: DataFrame) -> DataFrame:
    """Pairs (node, other) of texts under a key whose sizes, and places of the key in their prefixes, leave room for a similarity of 0.8."""
    small = few.where("indexed").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    large = few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    room = "(na < nb or (na = nb and a <> b)) and 5 * na >= 4 * nb and 9 * (1 + least(na - 1 - pa, nb - 1 - pb)) >= 4 * (na + nb)"
    return small.join(large, "key").where(room).select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("other")).distinct()


def _apart(f1: str, f2: str, g1: str, g2: str) -> Column:
    """How many bits of two fingerprints differ."""
    return F.bit_count(F.col(f1).bitwiseXOR(F.col(g1))) + F.bit_count(F.col(f2).bitwiseXOR(F.col(g2)))


def _near(n: str, m: str, apart: Column) -> Column:
    """Whether sizes and differing bits leave room for a similarity of 0.8."""
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n)) & ((apart <= FAR) | (F.greatest(n, m) <= SHORT))


def _not_far(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (node, other) of different components whose fingerprints do not rule out a similarity of 0.8."""
    one = nodes.select("node", "n", "f1", "f2", "comp")
    two = nodes.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("comp").alias("of"))
    return pairs.join(one, "node").join(two, "other").where("comp <> of").where(_near("n", "m", _apart("f1", "f2", "g1", "g2"))).select("node", "other")


def _leads(hot: DataFrame) -> DataFrame:
    """Pairs (node, other) of the texts under a hot key and its leaders, where not far apart and of different components."""
    out = None
    for turn in range(LEADERS):
        lead = hot.groupBy("key").agg(F.min_by(F.struct("node", "n", "f1", "f2", "comp"), F.xxhash64("node", F.lit(turn))).alias("l"))
        lead = lead.select("key", F.col("l.node").alias("lead"), F.col("l.n").alias("m"), F.col("l.f1").alias("g1"), F.col("l.f2").alias("g2"), F.col("l.comp").alias("of"))
        met = hot.join(lead, "key").where("comp <> of").where(_near("n", "m", _apart("f1", "f2", "g1", "g2")))
        met = met.select(F.least("node", "lead").alias("node"), F.greatest("node", "lead").alias("other")).distinct()
        out = met if out is None else out.union(met)
    return out.distinct()


def _nearest(hot: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (node, other): of each text under a hot key, the one not far from it that is nearest among those of another label.

    What meets here is summed up by node on the spot, so the pairs of a key are walked through and not kept.
    Of two texts with different labels one at least has another label than most under the key.
    """
    placed = hot.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    placed = written(placed, "placed")
    counts = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    most = counts.groupBy("key").agg(F.max_by("label", "c").alias("most"), F.count("*").alias("labels")).where("labels > 1").select("key", "most")
    left = placed.join(most, "key")
    one = left.where("label <> most").select("key", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "pos", "indexed", "f1", "f2", "label")))
    two = left.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "indexed", "f1", "f2", "label")))
    room = "label1 <> label2 and ((n1 <= n2 and indexed1) or (n2 <= n1 and indexed2)) and 9 * (1 + least(n1 - 1 - pos1, n2 - 1 - pos2)) >= 4 * (n1 + n2)"
    apart = _apart("f11", "f21", "f12", "f22")
    met = one.join(two, "key").where(room).where(_near("n1", "n2", apart)).withColumn("apart", apart)
    ends = F.array(*(F.struct(F.col(a).alias("node"), F.struct("apart", F.col(b).alias("other")).alias("e")) for a, b in (("node1", "node2"), ("node2", "node1"))))
    return met.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.min("x.e").alias("e")).select("node", F.col("e.other").alias("other"))


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Links (node, other) between texts of one family and different components (family, node, comp, n, s).

    A block holds texts of like sizes, dealt by a hash, so that no task orders or holds a family; texts of a
    family's largest component have blocks of their own. Pairs of blocks are drawn from their edges alone and
    fetch their texts afterwards. Blocks whose sizes differ too much, or that lie in one component, are not
    compared. What is left takes the square of a family.
    """
    counts = nodes.groupBy("family", "comp").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("comp", "c").alias("most"))
    # narrow rows settle the blocks; the sets join them by node, so no task has more than its share of a large family's
    like = 2 * F.floor(F.log("n") / F.log(F.lit(LIKE))) + (F.col("comp") == F.col("most")).cast("int")
    narrow = nodes.select("family", "node", "n", "comp").join(counts, "family").select("family", "node", "n", like.alias("class"))
    parts = narrow.groupBy("family", "class").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HELD)).alias("parts"))
    place = narrow.join(parts, ["family", "class"]).select("node", "class", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    blocks = nodes.join(place, "node").groupBy("family", "class", "part")
    blocks = written(blocks.agg(F.collect_list(F.struct("node", "comp", "s")).alias("all"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c"), F.max("comp").alias("d")), "blocks")

    def side(number: int, *columns: str) -> DataFrame:
        return blocks.select("family", *(F.col(c).alias(f"{c}{number}") for c in ("class", "part", *columns)))

    edges = ("low", "high", "c", "d")
    one = side(1, *edges).withColumn("salt", F.pmod(F.xxhash64("class1", "part1"), F.lit(SALTS)))
    two = side(2, *edges).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    ordered = "(class1 < class2 or (class1 = class2 and part1 <= part2))"
    meet = one.join(two, ["family", "salt"]).where(f"{ordered} and 5 * high1 >= 4 * low2 and not (c1 = d1 and c2 = d2 and c1 = c2)")
    meet = meet.select("family", "class1", "part1", "class2", "part2")
    meet = meet.join(side(1, "all"), ["family", "class1", "part1"]).join(side(2, "all"), ["family", "class2", "part2"])
    return meet.select(F.explode(text_udf(_block_links, LINKS)("all1", "all2")).alias("l")).select("l.node", "l.other")


def _members_of(links: DataFrame, nodes: DataFrame, to: str) -> DataFrame:
    """`nodes` with the component of `links` that each is in, itself where it is in none, in column `to`."""
    return nodes.join(connected_components(links, "node", "other"), "node", "left").withColumn(to, F.coalesce("component", "node")).drop("component")


def _within(sets: DataFrame, leads: DataFrame, linked: DataFrame) -> DataFrame:
    """Links (node, other) that join what is alike within each family (family, node, comp, n, s) and not `linked` yet.

    The texts of a family of up to BLOCK are compared at once. In a larger one each is compared with its
    leaders, and what these leave apart by blocks.
    """
    sizes = sets.groupBy("family").agg(F.count("*").alias("many"), F.sum("n").alias("held"))
    large = written(sizes.where(f"many > {BLOCK} or held > {HELD}").select("family"), "large")
    whole = sets.join(large, "family", "left_anti").groupBy("family").agg(F.collect_list(F.struct("node", "comp", "s")).alias("all"))
    links = written(whole.select(F.explode(text_udf(_block_links, LINKS)("all", "all")).alias("l")).select("l.node", "l.other"), "links")
    if large.isEmpty():
        return links
    sets = sets.drop("comp").join(large, "family")
    led = written(_alike(leads.join(sets.select("node"), "node", "left_semi"), sets), "links")
    members = written(_members_of(led.union(linked), sets.select("family", "node"), "comp"), "members")
    apart = members.groupBy("family").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("family")
    more = _in_blocks(members.join(apart, "family").join(sets.drop("family"), "node"))
    return links.union(led).union(written(more, "links"))


def _slots(wanted: DataFrame) -> np.ndarray:
    """A map of SLOTS bits, those set that a wanted `low` falls on."""
    slot = f"pmod(xxhash64(low), {SLOTS})"
    got = wanted.groupBy(F.expr(f"{slot} div 64").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def _may_hold(slots: np.ndarray):
    def may_hold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hashes in batches:
            slot = hashes.to_numpy().view(np.int64) % SLOTS
            yield pa.array((slots[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return may_hold


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row with an id, over texts whose five-word shingles are similar by 0.8 or more: id_col, set_key (digest of
    the shingle set), component_id (smallest id reachable) and head (the row, or its repeats, that stands for its component).

    Sets are linked first through the blocks of their 64-bit SimHash fingerprints (`fingerprint_links`, two bits), where
    the whole sets confirm it. Two fingerprints of that similarity may differ in more bits than blocks can bridge; so
    what the blocks leave apart is found by prefixes.

    Every link is a pair of that Jaccard similarity, and every such pair is in one component, but for
    pairs whose 128-bit SimHash fingerprints differ in more than FAR bits (one in a billion). Texts with one set of shingles are folded first; a component's name is the smallest id in it, and
    rows that share an id but no text are nodes of their own. Two sets of that similarity have their
    first common shingle in the prefix of the one and the shorter prefix of the other (`prefix_length`,
    `index_length`); texts meet there and are compared by their fingerprints. Those that are not far
    apart make up families, in which the whole sets decide. Common shingles come last
    in the order, so that texts with shingles of their own meet few others. Under a key of more than
    `hot` texts no pairs are kept but those of each text with leaders and with its nearest in other families.
    """
    spark = docs.sparkSession
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    marked = written(named.select("id", text_udf(_marks(common_shingles(named)), "struct<k1:bigint,k2:bigint,f1:bigint,f2:bigint,n:int,first:array<bigint>>")(F.col("t")).alias("f")).select("id", "f.*"), "marks")
    # a node for each set of shingles; numbered by the files' writer, so it is fixed from here on
    nodes = marked.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.first("n").alias("n"), F.first("first").alias("first"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    prefixes, marked = marked, written(marked.select("id", "k1", "k2"), "names")
    discard(prefixes)
    free_shuffles(spark)
    repeated = not marked.groupBy("id").count().where("count > 1").isEmpty()

    def sets_of(wanted: DataFrame) -> DataFrame:
        """`wanted`, with n and s (its shingles) for each node. Of other texts few take part in the join, whatever its kind."""
        own = wanted.columns
        wanted = wanted.join(nodes.select("node", "low", F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "node")
        wanted = written(wanted, "wanted")
        # nondeterministic, as conditions on what a deterministic function gives make Spark run it once more on either side of the join
        may_hold = text_udf(_may_hold(_slots(wanted)), "boolean").asNondeterministic()
        keyed = text_udf(_keyed_sets, "struct<k1:bigint,k2:bigint,s:array<bigint>>").asNondeterministic()
        some = named.where(may_hold(F.xxhash64("id")))
        made = some.join(wanted, some.id == F.col("low")).select(*own, "__k1", "__k2", keyed(F.col("t")).alias("f"))
        made = made.where("f.k1 = __k1 and f.k2 = __k2").select(*own, F.size("f.s").alias("n"), "f.s")
        return written(made.dropDuplicates(["node"]) if repeated else made, "sets")  # rows may repeat an id and its text

    blocked = written(_by_blocks(nodes), "pairs")
    held = sets_of(blocked.select("node").union(blocked.select("other")).distinct())
    linked = written(_alike(blocked, held), "links")
    discard(held)
    prints = written(_members_of(linked, nodes.select("node", "n", "f1", "f2"), "comp"), "prints")
    free_shuffles(spark)
    filed = nodes.select("node", "n", F.posexplode("first").alias("pos", "key")).withColumn("indexed", F.expr("pos < n div 9 + 1"))
    shared = filed.groupBy("key").agg(F.count("*").alias("many"), F.count_if("indexed").alias("held")).where("many > 1 and held > 0")
    rows = written(filed.join(shared.select("key", "many").hint("merge"), "key"), "filed")
    few = written(_not_far(_candidates(rows.where(F.col("many") <= hot)), prints), "pairs")
    many = written(rows.where(F.col("many") > hot).drop("many").join(prints.drop("n"), "node"), "hot")
    discard(rows)
    leads = written(_leads(many), "pairs")
    pairs = few.union(leads)
    while True:  # until no two texts under a hot key that are not far apart are in different families
        families = connected_components(pairs.union(linked), "node", "other")
        more = written(_nearest(many, families), "pairs")
        if more.isEmpty():
            break
        pairs = pairs.union(more)
    families = families.withColumnRenamed("component", "family").join(prints.select("node", "comp"), "node")
    open_ones = families.groupBy("family").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("family")
    families = written(families.join(open_ones, "family"), "families")
    free_shuffles(spark)
    links = linked.union(_within(sets_of(families), leads, linked))
    free_shuffles(spark)
    tree = connected_components(links, "node", "other")
    rooted = nodes.join(tree.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("k1", "k2", "low", F.coalesce("component", "node").alias("root"))
    rooted = written(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min(F.struct("low", "k1", "k2")).alias("first"))
    is_first = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))
    component = rooted.join(heads.hint("merge"), "root").select("k1", "k2", F.col("first.low").alias("component_id"), is_first.alias("first_set"))
    out = marked.select("id", "k1", "k2").join(component.hint("merge"), ["k1", "k2"])
    for table in (many, nodes):
        discard(table)
    return out.select(F.col("id").alias(id_col), F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")).alias("set_key"), "component_id", (F.col("first_set") & (F.col("id") == F.col("component_id"))).alias("head"))


def _set_keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in sliced(batches):
        yield pa.array(["".join(f"{int(k) & (1 << 64) - 1:016X}" for k in _key(shingle_set(t.as_py()))) for t in texts], pa.string())


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each component of `groups` (see `similar_documents`), that of the smallest id, columns unchanged.

    Rows that share an id are told apart by their texts: of rows that repeat a kept id and its text
    one stays, a row with that id and a text of another component is judged on its own. Rows with a
    null id stay, as nothing names them.
    """
    per = groups.groupBy(F.col(id_col).alias("__head")).agg(F.count("*").alias("__rows"), F.max("head").alias("__kept"))
    odd = written(per.where("not __kept or __rows > 1"), "odd")  # all other ids stay; where these are few, Spark broadcasts them
    kept = docs.join(odd.select("__head"), docs[id_col] == F.col("__head"), "left_anti")
    again = odd.where("__kept")
    if not again.isEmpty():
        keys = groups.where("head").select(F.col(id_col).alias("__head"), F.col("set_key").alias("__key")).distinct()
        rows = docs.join(again, docs[id_col] == F.col("__head"), "left_semi").withColumn("__own", text_udf(_set_keys, "string")(F.col(text)))
        rows = rows.join(keys.hint("merge"), (F.col(id_col) == F.col("__head")) & (F.col("__own") == F.col("__key")), "left_semi")
        kept = kept.union(rows.dropDuplicates([id_col, "__own"]).select(*docs.columns))
    return kept.select(*docs.columns)
