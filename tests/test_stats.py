import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.operators import aggregates as A
from textgauge.operators import stats, stream


def direct(e, r, n, seed):
    idx = np.random.default_rng(seed).integers(0, len(e), size=(n, len(e)))
    es, rs = np.asarray(e, float)[idx].sum(axis=1), np.asarray(r, float)[idx].sum(axis=1)
    return tuple(np.percentile(np.divide(es, rs, out=np.zeros(n), where=rs != 0), [2.5, 97.5]))


def test_interval_is_that_of_one_draw(monkeypatch):
    e, r = [0, 1, 2, 0, 3, 1, 0, 2, 1, 0, 4, 0, 1, 2, 0], [10] * 15
    want = direct(e, r, 2000, 42)
    assert stats.bootstrap_ci(e, r, 2000, 42) == want
    monkeypatch.setattr(stats, "_AT_ONCE", 101)  # drawn in parts it is the same stream
    assert stats.bootstrap_ci(e, r, 2000, 42) == want
    assert direct(e, r, 2000, 43) == stats.bootstrap_ci(e, r, 2000, 43)
    assert not np.array_equal(*(stats._index_sums([np.asarray(e, float)], 50, s)[0] for s in (1, 2)))
    assert want[0] <= sum(e) / sum(r) <= want[1]
    assert (stats.RESAMPLES, stats.SEED) == (10_000, 20_260_704)


def test_paired():
    a, b, n = [5, 4, 6, 3, 5, 4, 6, 3, 5, 4], [1, 2] * 5, [10] * 10
    assert stats.paired_diff_ci(a, n, b, n, 1000)[0] > 0
    assert stats.paired_diff_ci(b, n, b, n, 1000) == (0, 0)
    with pytest.raises(ValueError):
        stats.paired_diff_ci([1, 2], [1, 2], [1, 2, 3], [1, 2, 3])


ENGINES = {"best": [0] * 20, "mid": [0, 1] * 10, "worst": [8] * 20}


def test_tie_groups():
    tiers = stats.tie_groups({k: (v, [10] * 20) for k, v in ENGINES.items()}, 1000)
    assert tiers[0][0] == "best" and tiers[-1] == ["worst"]
    same = ([1, 2, 0, 3, 1, 2, 0, 1], [10] * 8)
    assert stats.tie_groups({"c": same, "a": same, "b": same}, 500) == [["a", "b", "c"]]
    assert stats.tie_groups({}) == []


def test_tables_agree_with_memory(spark):
    rows = [("a", "en", k, f"u{i:03d}", e, 10) for k, v in ENGINES.items() for i, e in enumerate(v)]
    df = spark.createDataFrame(rows, "track string, lang string, engine string, utt_id string, errors int, ref_len int").repartition(3)
    ci = {r.engine: (r.lo, r.hi) for r in stats.cell_intervals(df, ["engine"], n=500).collect()}
    assert ci == {k: stats.bootstrap_ci(v, [10] * 20, 500) for k, v in ENGINES.items()}
    assert stats.tie_group_table(df, ["track", "lang"], n=500).first().tie_groups == stats.tie_groups({k: (v, [10] * 20) for k, v in ENGINES.items()}, 500)
    pairs = {(r.worse, r.better): (r.lo, r.hi) for r in stats.paired_intervals(df, ["track", "lang"], n=500).collect()}
    assert pairs == {(a, b): stats.paired_diff_ci(ENGINES[a], [10] * 20, ENGINES[b], [10] * 20, 500) for a, b in (("mid", "best"), ("worst", "best"), ("worst", "mid"))}


@pytest.mark.parametrize("size", [1, 2, 3, 64, 200, 1000, 3_000_000_019, (1 << 31) + 1])
def test_segments_give_the_stream_of_one_draw(monkeypatch, size):
    monkeypatch.setattr(stream, "_AT_ONCE", 37)
    draws = 3001
    n, start, out = stream.segments(draws, size, 64), 0, []
    for k in range(n):
        out += [x for part in stream.draw(5, size, k, 64, k == n - 1, draws - start) for x in part.tolist()]
        start += stream.count_kept(5, size, k, 64) if size > 1 else 0
        assert k == n - 1 or len(out) == min(start, draws)
    assert out == np.random.default_rng(5).integers(0, size, draws).tolist()
    assert n > 1 or size == 1
    if size == 3_000_000_019:
        assert stream.rejected(size) > 0.3 * 2**32


@pytest.mark.parametrize("block", [7, 1000])
def test_sums_of_many_segments_and_blocks(spark, block):
    """Cells of several sizes, ids that repeat, and more segments and blocks than one."""
    n, sizes = 40, {"a": 1, "b": 2, "c": 30, "d": 64, "e": 333}
    rng = np.random.default_rng(8)
    rows = [(c, f"u{i // 2 if c == 'c' else i:04d}", int(rng.integers(0, 9)), int(rng.integers(0, 40))) for c, s in sizes.items() for i in range(s)]
    df = spark.createDataFrame(rows, "frame string, o string, e int, r int").repartition(5)
    made = stats.resampled_sums(df.withColumns({"member": F.lit("m"), "k": F.struct("e", "r")}), n, 77, block, lambda size: 256)
    got = {}
    for row in made.collect():
        for i, x in enumerate(zip(row.e, row.r, strict=True)):
            was = got.get((row.frame, row.begin + i), (0, 0))
            got[(row.frame, row.begin + i)] = (was[0] + x[0], was[1] + x[1])
    assert len(got) == n * len(sizes)
    for c in sizes:
        cell = sorted((o, e, r) for f, o, e, r in rows if f == c)
        e, r = stats._index_sums([np.array([x[k] for x in cell], float) for k in (1, 2)], n, 77)
        assert [got[(c, i)] for i in range(n)] == list(zip(e, r))


def test_engines_with_other_utterances_are_paired_over_what_they_share(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f"u{i:03d}", int(rng.integers(0, 4)), 10) for k, n in (("a", 30), ("b", 20), ("c", 25)) for i in range(30 - n, 30)]
    got = {(r.worse, r.better): (r.lo, r.hi) for r in stats.paired_intervals(spark.createDataFrame(rows, "engine string, utt_id string, errors int, ref_len int").withColumn("lang", F.lit("en")), ["lang"], n=300).collect()}
    by = {k: {u: e for x, u, e, _ in rows if x == k} for k in "abc"}
    for (worse, better), interval in got.items():
        both = sorted(by[worse].keys() & by[better].keys())
        assert interval == stats.paired_diff_ci([by[worse][u] for u in both], [10] * len(both), [by[better][u] for u in both], [10] * len(both), 300)
    assert len(got) == 3


def test_rates(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("b", 1, 1), ("b", 0, 99), ("c", 2, 0), ("d", 0, 0)], "k string, e int, n int")
    got = {r.k: (r.c, r.m) for r in df.groupBy("k").agg(A.corpus_rate(F.col("e"), F.col("n")).alias("c"), A.utterance_mean(F.col("e"), F.col("n")).alias("m")).collect()}
    assert got["a"][0] == 3 / 8 and abs(got["a"][1] - (1 / 3 + 2 / 5) / 2) < 1e-15
    assert got["b"] == (0.01, 0.5) and got["c"] == (1.0, 1.0) and got["d"] == (0.0, 0.0)
    none = df.where("false").agg(A.corpus_rate(F.col("e"), F.col("n")).alias("c"), A.utterance_mean(F.col("e"), F.col("n")).alias("m")).first()
    assert tuple(none) == (0.0, 0.0)


def test_small_expressions(spark):
    df = spark.createDataFrame([(" 　\x1c", None, 2.0), (None, 0.0, 1.0), ("x", 2.0, None)], "t string, d double, l double")
    got = df.select(A.is_empty(F.col("t")), A.real_time_factor(F.col("l"), F.col("d")), A.judge_median(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)))).collect()
    assert [tuple(r) for r in got] == [(True, None, 2.0), (True, None, 2.0), (False, 0.0, 2.0)]


def _frames_of(monkeypatch) -> list:
    seen, made = [], stats.resampled_sums

    def watched(rows, *args, **kw):
        seen.append({(r.frame, r.member): r.n for r in rows.groupBy("frame", "member").agg(F.count("*").alias("n")).collect()})
        return made(rows, *args, **kw)

    monkeypatch.setattr(stats, "resampled_sums", watched)
    return seen


def test_pairs_with_the_same_utterances_share_their_resamples(spark, monkeypatch):
    """Of four engines the shortest shares the same rows with all others, the next the same with two."""
    seen, rng = _frames_of(monkeypatch), np.random.default_rng(4)
    rows = [(k, i, int(rng.integers(0, 4)), 10) for k, n in (("a", 30), ("b", 20), ("c", 25), ("d", 30)) for i in range(n)]
    made = stats.paired_intervals(spark.createDataFrame(rows, "engine string, utt_id long, errors int, ref_len int").withColumn("lang", F.lit("en")), ["lang"], n=300)
    by = {k: [e for x, _, e, _ in rows if x == k] for k in "abcd"}
    for r in made.collect():
        n = min(len(by[r.worse]), len(by[r.better]))
        assert (r.lo, r.hi) == stats.paired_diff_ci(by[r.worse][:n], [10] * n, by[r.better][:n], [10] * n, 300)
    assert sorted(seen[0].values()) == [20] * 4 + [25] * 3 + [30] * 2 and len({f for f, _ in seen[0]}) == 3


def test_intervals_know_no_nulls(spark):
    rows = [("a", f"u{i:02d}", None if i == 3 else i % 3, None if i == 3 else 10) for i in range(12)]
    got = stats.cell_intervals(spark.createDataFrame(rows, "engine string, utt_id string, errors int, ref_len int"), ["engine"], n=200).first()
    assert (got.lo, got.hi) == stats.bootstrap_ci([e or 0 for *_, e, _ in rows], [r or 0 for *_, r in rows], 200)


def test_a_task_is_given_arrays(spark):
    """A row for each member and block, not one for each utterance with the names of its frame and member."""
    rows = spark.range(100).selectExpr("'f' AS frame", "'m' AS member", "id AS o", "id AS k", "id % 3 AS e", "10L AS r")
    plan = stats.resampled_sums(rows, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan[plan.index("FlatMapGroups"):]


def test_cells_of_one_size_share_their_resamples(spark, monkeypatch):
    seen = _frames_of(monkeypatch)
    rows = [(f"c{k:02d}", i, (i * k) % 5, 10) for k in range(18) for i in range(9)] + [("d", i, 1, 10) for i in range(4)]
    got = stats.cell_intervals(spark.createDataFrame(rows, "engine string, utt_id long, errors int, ref_len int"), ["engine"], n=100)
    assert {r.engine: (r.lo, r.hi) for r in got.collect()} == {k: stats.bootstrap_ci([e for x, _, e, _ in rows if x == k], [10] * sum(x == k for x, *_ in rows), 100) for k in {x for x, *_ in rows}}
    assert sorted(sum(f == frame for f, _ in seen[0]) for frame in {f for f, _ in seen[0]}) == [1, 2, 16]


def test_blocks_are_as_large_as_the_members_of_a_frame_leave_room_for(spark, monkeypatch):
    assert stats.block_rows(4) == stats.BLOCK * stats.MEMBERS // 4 and stats.block_rows(stats.MEMBERS) == stats.block_rows(100) == stats.BLOCK
    monkeypatch.setattr(stats, "BLOCK", 8)
    monkeypatch.setattr(stats, "MEMBERS", 8)
    rows = spark.range(60).selectExpr("'f' AS frame", "cast(id % 2 AS string) AS member", "id div 2 AS o", "0 AS k", "id % 7 AS e", "10 + id % 5 AS r")
    whole, parts = (stats.resampled_sums(rows, 50, block=block) for block in (None, 8))  # 32 rows of two members, or 8
    assert "explode" not in whole._jdf.queryExecution().analyzed().toString() and "explode" in parts._jdf.queryExecution().analyzed().toString()
    one, other = ({r.member: r.rates for r in stats._vectors(x, 50).collect()} for x in (whole, parts))
    assert one == other and len(one["0"]) == 50


@pytest.mark.parametrize("size", [3, 1000, 3_000_000_019])
def test_segments_are_counted_without_their_indexes(monkeypatch, size):
    monkeypatch.setattr(stream, "_IN_CACHE", 37)
    want = len(stream._kept(stream._generator(5, 600), 200, size))
    monkeypatch.delattr(stream, "_kept")
    assert stream.count_kept(5, size, 3, 200) == want


@pytest.mark.parametrize(("low", "wide"), [(0, 30), (0, 10), (10, 13), (23, 7)])
def test_choices_are_counted_at_once_or_resample_by_resample(monkeypatch, low, wide):
    idx, ends = np.random.default_rng(6).integers(0, 30, 100), [0, 8, 38, 68, 98, 100]
    want = [[float((idx[a:b] == x).sum()) for x in range(low, low + wide)] for a, b in zip(ends, ends[1:])]
    for long in (10, 1000):
        monkeypatch.setattr(stats, "_LONG", long)
        assert stats._counts(idx, np.array(ends), low, wide, 30).tolist() == want
