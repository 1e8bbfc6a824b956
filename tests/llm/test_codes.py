import hashlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from helpers import clashing
from pyspark.sql import functions as F
from textgauge.llm import codes, queries

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """(id, codes, error, label_error) and the codebooks, in Python integers."""
    whole = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in sorted((r for r in whole if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    d = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    seeds = list(first.values())[:entries]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        told = [[nearest(v, p) for p in range(parts)] for _, v, _ in whole]
        new = [list(b) for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), t in zip(whole, told, strict=True) if t[p] == e]
                if mine:
                    new[p][e] = [int(np.floor(Fraction(sum(c), len(mine)))) for c in zip(*mine, strict=True)]
        books = new
    out = [(i, [nearest(v, p) for p in range(parts)], v, lab) for i, v, lab in whole]
    out = [(i, t, sum(far(cut(v, p), books[p][t[p]]) for p in range(parts)), lab) for i, t, v, lab in out]
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return [(i, t, e, total[lab]) for i, t, e, lab in out], np.array(books)


def vectors(n, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.float32(rng.normal(size=dim) * 0.1)], int(rng.integers(3))) for i in rng.permutation(n)]


def odd(n=90):
    rows = vectors(n)
    bad = [0.1] * 31
    rows += [(500, None, 1), (501, [*bad, None], 1), (502, [*bad, float("nan")], None), (503, [*bad, float("-inf")], 1), (None, rows[3][1], None), (504, rows[4][1], None), (-7, [0.0] * 32, 2), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("width", [4, 7])
@pytest.mark.parametrize("scale", [3, 300, 2**20])
def test_screening_gives_the_exact_nearest(width, scale):
    rng = np.random.default_rng(scale + width)
    entries = rng.integers(-scale, scale + 1, (64, width))
    entries[40] = entries[3]
    points = np.concatenate((rng.integers(-scale, scale + 1, (500, width)), entries, (entries[:-1] + entries[1:]) // 2))
    best, recomputed = codes.nearest(points, entries)
    far = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert best.tolist() == [int(np.argmin(r)) for r in far] and (recomputed > 0)


def test_ties_beyond_single_precision():
    """Entries that single precision cannot tell apart."""
    base = np.array([2**25, 2**25 - 1, 5, 7])
    entries = np.array([base + [k, -k, 0, 0] for k in range(3, -1, -1)])
    points = np.array([base + [0, 0, 1, 0], base + [2, -2, 0, 0], base + [5, 0, 0, 0]])
    best, recomputed = codes.nearest(points, entries)
    far = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert best.tolist() == [int(np.argmin(r)) for r in far] and recomputed > 3


def test_equals_plain_rounds(spark):
    rows = odd()
    df = clashing(spark.createDataFrame(rows, KIND).repartition(3)).withColumn("codes", F.lit(1)).withColumn("error", F.lit(2)).withColumn("v", F.lit("x"))
    made, books = codes.compress(df, parts=4, entries=16, rounds=2)
    want, entries = plain(rows, 4, 16, 2)
    assert (books.entries == entries).all() and made.columns == ["vec_id", "label", "codes", "error", "label_error"]
    assert sorted(((r.vec_id, r.codes, r.error, r.label_error) for r in made.collect()), key=repr) == sorted(want, key=repr)
    assert books.digest() == hashlib.sha256(",".join(str(x) for p in entries.tolist() for e in p for x in e).encode()).hexdigest()


def test_many_labels_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(codes, "MAX_SENT", 1)
    rows = odd()
    made, _ = codes.compress(spark.createDataFrame(rows, KIND).repartition(3), parts=4, entries=8)
    assert sorted(((r.vec_id, r.codes, r.error, r.label_error) for r in made.collect()), key=repr) == sorted(plain(rows, 4, 8, 2)[0], key=repr)


def test_sums_leave_before_they_overflow(spark):
    rows = [(i, [2.0**17 + i] * 4, 0) for i in range(40)]
    made, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=2, rounds=3)
    want, entries = plain(rows, 2, 2, 3)
    assert (books.entries == entries).all() and sorted((r.vec_id, r.codes, r.error, r.label_error) for r in made.collect()) == sorted(want)


def test_few_none_and_refused(spark):
    made, books = codes.compress(spark.createDataFrame(vectors(5), KIND), parts=4)
    assert books.entries.shape == (4, 5, 8) and made.count() == 5
    made, books = codes.compress(spark.createDataFrame([(1, None, 0), (2, [float("nan")], 1)], KIND))
    assert made.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    assert codes.compress(spark.createDataFrame([], KIND))[0].count() == 0
    for rows, error in (([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], "one length"), ([(1, [1.0] * 15, 0)], "multiple"), ([(1, [], 0)], "multiple"), ([(1, [3e38] * 16, 0), (2, [0.0] * 16, 0)], "too large")):
        with pytest.raises(Exception, match=error):
            codes.compress(spark.createDataFrame(rows, KIND))[0].collect()
    with pytest.raises(ValueError, match="256"):
        codes.compress(spark.createDataFrame([], KIND), entries=257)


def test_decoding_gives_what_the_error_says(spark):
    df = spark.createDataFrame(vectors(200), KIND)
    books = codes.fit(df, parts=8)
    for r in codes.decode(codes.encode(df, books), books).collect():
        assert sum((int(np.floor(256 * x)) - y) ** 2 for x, y in zip(r.embedding, r.decoded, strict=True)) == r.coded.error


def test_query_equals_plain_rounds(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").limit(150).collect()]
    want, _ = plain(rows, 16, 64, 2)
    made, _ = codes.compress(spark.createDataFrame(rows, KIND))
    found = made.select("vec_id", codes.hex_code(F.col("codes")).alias("code"), "error", "label_error").collect()
    assert sorted(map(tuple, found)) == sorted((i, "".join(f"{c:02x}" for c in t), e, le) for i, t, e, le in want)
    assert queries.op12_vector_codes(spark, SMALL).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
