import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import union_find

from textgauge.llm import embeddings


def brute(rows, threshold=0.9):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and (cos(ok[a], ok[b]) >= threshold or np.array_equal(ok[a], ok[b]))]
    n = {i: sum(i in p for p in links) for i, _ in rows}
    return n, union_find(links, [i for i, _ in rows if i is not None])


def vectors(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = out[int(rng.integers(len(out)))] + rng.normal(0, 0.1, dim) if i > 20 and rng.random() < 0.5 else rng.normal(0, 1, dim)
        out.append(v)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("tile", [16, 64, 4096])
def test_all_pairs(spark, tile):
    rows = vectors(tile)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string")
    n, component = brute(rows)
    got = embeddings.near_duplicates(df, tile=tile).collect()
    assert {r.vec_id: r.n_links for r in got} == n
    assert {r.vec_id: r.component_id for r in got} == component
    assert all(r.kept == (r.vec_id == component[r.vec_id]) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0]), (11, [1e-30, 0.0]), (12, [3e38, 3e37]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    n, component = brute(rows)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: got[i].n_links for i, _ in rows} == n and {i: got[i].component_id for i, _ in rows} == component
    assert got[None].component_id is None and got[None].kept is False and got[None].n_links == 0
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_many_copies(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"))
    assert {(r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == {(299, 0)}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    u = embeddings.unit(rng.normal(0, 1, (300, 1500)) * rng.choice([1e-3, 1, 1e3], (1, 1500)))
    codes, scale, error = embeddings.quantise(u)
    exact, rough = u @ u.T, embeddings._products(codes, codes) * scale[:, None] * scale
    assert (np.abs(exact - rough) <= error[:, None] + error * (1 + error[:, None]) + 1e-12).all()


def test_only_doubtful_pairs_are_recomputed():
    rng = np.random.default_rng(2)
    side = lambda u: dict(zip(("codes", "scale", "error"), embeddings.quantise(u))) | {"u": u, "weight": np.ones(len(u))}
    a = side(embeddings.unit(rng.normal(0, 1, (500, 64))))
    _, _, recomputed = embeddings.compare_tiles(a, None, 0.3)
    assert 0 < recomputed < 500 * 499 / 2 / 20


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_cells_far_apart_never_meet(spark, monkeypatch):
    """Tight clusters around the axes: only tiles of one cell are compared, and all links are found."""
    rng, met = np.random.default_rng(3), []
    rows = [(100 * k + i, (np.eye(6)[k] + 0.01 * rng.standard_normal(6)).tolist()) for k in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df, tile=10).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (39, i // 100 * 100) for i, _ in rows}
