import random

from pyspark.sql import functions as F

from textgauge.operators import align
from textgauge.plans.goldens import ALIGNMENTS


def plain(ref, hyp):
    """The whole table and the walk back, cell by cell."""
    n, m = len(ref), len(hyp)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = n, m, {"sub": 0, "del": 0, "ins": 0, "ref_len": n}
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            out["sub"] += 1
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out["del"] += 1
            i -= 1
        else:
            out["ins"] += 1
            j -= 1
    return out


def test_published_alignments():
    for ref, hyp, s, d, i, n in ALIGNMENTS:
        assert align.edit_ops(ref.split(), hyp.split()) == {"sub": s, "del": d, "ins": i, "ref_len": n}
    assert sum(list(align.edit_ops("敵対的環境コース", "敵対的環境構成").values())[:3]) == 3


def test_against_the_whole_table():
    rng = random.Random(1)
    for _ in range(300):
        ref, hyp = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(2))
        assert align.edit_ops(ref, hyp) == plain(ref, hyp)


def test_bands_and_blocks(monkeypatch):
    """Bands that must be widened, and columns computed again on the way back."""
    monkeypatch.setattr(align, "FIRST_BAND", 2)
    monkeypatch.setattr(align, "HELD_BITS", 100)
    rng = random.Random(4)
    for n in [0, 1, 2, 17, 50, 120] * 40:
        ref = [rng.choice("abcd") for _ in range(n)]
        hyp = list(ref)
        for _ in range(rng.randint(0, n)):
            k = rng.randint(0, len(hyp))
            hyp[k : k + rng.randint(0, 2)] = rng.choice(["", "a", "dcb"])
        assert align.edit_ops(ref, hyp) == plain(ref, hyp)


def test_rows_are_dealt_by_what_they_cost(spark):
    costs = [10_000.0] + [100.0] * 200 + [1.0] * 3000 + [None]
    df = spark.createDataFrame(list(enumerate(costs)), "id int, cost double").repartition(2)
    made = align.by_cost(df, F.col("cost"), each=2000).withColumn("part", F.spark_partition_id())
    rows = made.collect()
    load = {}
    for r in rows:
        load[r.part] = load.get(r.part, 0) + (r.cost or 1)
    assert sorted(r.id for r in rows) == list(range(len(costs))) and made.rdd.getNumPartitions() == -(-33_001 // 2000)
    big = next(r.part for r in rows if r.cost == 10_000)
    assert all(v < 4000 for p, v in load.items() if p != big) and load[big] < 12_500
    assert align.by_cost(df.where("false"), F.col("cost")).count() == 0
    again = {r.id: r.part for r in align.by_cost(df.repartition(3), F.col("cost"), each=2000).withColumn("part", F.spark_partition_id()).collect()}
    assert again == {r.id: r.part for r in rows}
    pairs = spark.createDataFrame([(["a", "b"], ["b"]), (None, ["a"]), (["a"], None)], "r array<string>, h array<string>")
    found = {tuple(x.r or "-"): x.ops for x in align.split_pairs(pairs, "r", "h").collect()}
    assert found[("a", "b")].asDict() == plain("ab", "b") and found[("-",)] is None and found[("a",)].asDict() == plain("a", "")


def test_columns_agree(spark):
    rng = random.Random(2)
    rows = [([rng.choice("abcdef") for _ in range(rng.randint(0, 9))], [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame([*rows, (["a"], None)], "ref array<string>, hyp array<string>")
    split = align.edit_split(F.col("ref"), F.col("hyp"))
    for r in df.select("ref", "hyp", align.word_errors(F.col("ref"), F.col("hyp")).alias("n"), split.alias("s")).collect():
        want = plain(r.ref, r.hyp or [])
        assert r.s.asDict() == want and r.n == want["sub"] + want["del"] + want["ins"]
    assert df.select(align.char_errors(F.lit("敵対"), F.lit(None).cast("string"))).first()[0] == 2
