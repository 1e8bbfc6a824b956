import hashlib
import random
from functools import reduce

import numpy as np
import pytest
from conftest import SMALL
from helpers import DOCS, clashing, empty, odd, odd_rows, prose
from pyspark.sql import functions as F
from textgauge.llm import queries, sketches
from textgauge.llm.sketches import complete_below, containment, merged, packed, sketch, unpacked


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """The circle of (id, text) rows, one after another."""
    from xxhash import xxh64_intdigest

    def low(t):
        return (lambda h: h - (1 << 64) if h >> 63 else h)(xxh64_intdigest(t.encode(), 42))

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), low(r[1]), r[1].encode()))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        new = t[: len(t) - k] + after[:k]
        a, b, c = sketch(t), sketch(new), sketch(after)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), packed(a), packed(b), containment(a, b), containment(a, c)))
    return out


def test_a_sketch_holds_every_low_hash_and_the_least():
    long, short = sketch(prose(30_000, 1)), sketch(prose(100, 2))
    assert len(long) > sketches.LEAST and (long < np.uint64(sketches.THRESHOLD)).all() and complete_below(long) == sketches.THRESHOLD
    assert len(short) == sketches.LEAST and complete_below(short) == int(short[-1]) + 1
    assert len(sketch("a b c")) == 1 and not len(sketch(" \n")) and not len(sketch(None))
    assert complete_below(sketch("one two three four five six")) == sketches.RANGE
    assert (sketch("A  b\tC\nd e") == sketch("a b c d E")).all() and (unpacked(packed(long)) == long).all()


def test_steps_change_nothing(monkeypatch):
    text = prose(3000, 3)
    whole = sketch(text)
    monkeypatch.setattr(sketches, "STEP", 70)
    assert (sketch(text) == whole).all()


def test_sketches_merge_exactly():
    rng = random.Random(4)
    for sizes in ([10, 3, 40], [200, 5], [5000, 20, 7], [1, 0, 2]):
        hashes = [np.array([rng.getrandbits(48) for _ in range(n)], np.uint64) for n in sizes]
        one = reduce(lambda a, b: merged([a, b]), (sketches._kept(h) for h in hashes))
        assert (one == sketches._kept(np.concatenate(hashes))).all()
        assert (one == merged([sketches._kept(h) for h in hashes])).all()


def test_estimates_are_near_the_true_containment():
    rng, off = random.Random(5), []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([300, 1000, 6000]))]
        part = " ".join(words[: rng.randrange(60, len(words))])
        both = part + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 20_000)))
        a, b = " ".join(words), both
        true = len(shingles(a) & shingles(b)) / len(shingles(a))
        off.append(containment(sketch(a), sketch(b)) - true)
    assert abs(np.mean(off)) < 0.05 and np.sqrt(np.mean(np.square(off))) < 0.13


def test_unlike_and_equal():
    a, b, none = sketch(prose(200, 1)), sketch("x " * 500), sketch("")
    assert containment(a, a) == 1 and containment(none, none) == 1 and containment(a, none) == 0 == containment(none, a) and containment(a, b) == 0


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_circle_equals_a_plain_walk(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = odd_rows() + [(i, prose(i % 90, i), "en", "a", 0) for i in range(11, 70)]
        made = sketches.edited_likeness(clashing(spark.createDataFrame(rows, DOCS).repartition(4)))
        assert made.columns == ["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next"]
        found = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in made.collect()]
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, found)) == sorted(map(repr, plain([(r[0], r[1]) for r in rows])))


def test_empty_and_single_tables(spark):
    assert sketches.edited_likeness(empty(spark)).count() == 0
    one = sketches.edited_likeness(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.n_chars == 11 and one.edited_sha256 == hashlib.sha256(b"a b c d " + b"a b").hexdigest()


def test_query_equals_a_plain_walk(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_document_sketch(spark, SMALL).collect()
    want = {r[0]: r for r in plain([tuple(r) for r in docs])}
    assert len(found) == len(docs)
    for r in found:
        i, n, sha, a, b, x, y = want[r.doc_id]
        assert tuple(r) == (i, n, sha, a.hex(), b.hex(), x, y)
    assert 0.6 < np.mean([r.near_edited for r in found]) < 0.73 and np.mean([r.near_next for r in found]) < 0.05


def test_groups_hold_what_their_members_hold(spark):
    rows = [(i, prose(4000, i), "en", f"s{i % 3}", 0) for i in range(6)] + [(6, prose(4000, 0), "en", None, 0), (7, None, "en", "s0", 0)]
    docs = sketches.sketches(spark.createDataFrame(rows, DOCS))
    found = {(r.doc_id, r.source): r.shared for r in sketches.group_containment(docs, "source").collect()}
    low = {i: {int(x) for x in sketch(t) if x < sketches.THRESHOLD} for i, t, *_ in rows}
    groups = {s: set().union(*(low[r[0]] for r in rows if r[3] == s)) for s in ("s0", "s1", "s2", None)}
    want = {(i, s): len(low[i] & g) / len(low[i]) for i in low for s, g in groups.items() if low[i] & g}
    assert {(i, s) for i, s in found} == {(i, s) for i, s in want} and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert found[(6, "s0")] == 1 == found[(0, None)] and all(i != 7 for i, _ in found)
    pair = docs.where("doc_id = 0").select(F.col("sketch").alias("a")).crossJoin(docs.where("doc_id = 6").select(F.col("sketch").alias("b")))
    assert pair.select(sketches.contained(F.col("a"), F.col("b"))).first()[0] == 1
