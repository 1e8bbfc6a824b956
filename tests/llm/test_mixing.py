import numpy as np
from helpers import clashing, empty, odd, prose

from textgauge.llm import mixing


def test_targets():
    assert mixing.fill_targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    sizes = [10, 1000, 1000, 5]
    t = mixing.fill_targets(sizes)
    assert t[0] == 30 and t[3] == 15 and abs(sum(t) - sum(sizes)) < 1e-9 and all(a <= 3 * b for a, b in zip(t, sizes))
    assert abs(t[1] / t[2] - 2) < 1e-9
    assert mixing.fill_targets([]) == [] and mixing.fill_targets([0, 7]) == [0.0, 7.0]


def test_permutations_are_bijections():
    for n in (1, 2, 3, 64, 1000):
        for key in (1, 2, 99):
            i = np.arange(n)
            assert sorted(mixing.permuted(i, np.full(n, n), np.full(n, key, np.uint64)).tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (5, 6))
    assert (a != b).mean() > 0.9


def test_shards_owe_nothing():
    rows = mixing.draw_shards([500, 20, 0, 3], [75] * 6 + [73])
    for s, n in enumerate([500, 20, 0, 3]):
        own = sorted((f, c) for _, x, f, c in rows if x == s)
        assert sum(c for _, c in own) == n and [f for f, _ in own] == np.cumsum([0, *(c for _, c in own)])[: len(own)].tolist()
    assert [sum(c for sh, _, _, c in rows if sh == k) for k in range(7)] == [75] * 6 + [73]


def test_every_shard_has_the_stated_size_however_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 8)
    mix = mixing.Mix(documents(spark), block_words=4)
    per = {r.shard: r.n for r in mix.slots.groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    total = sum(per.values())
    assert len(per) == -(-total // 8) > 500 and sorted(per) == list(range(len(per)))
    assert [per[k] for k in sorted(per)] == [8] * (total // 8) + [total % 8] * (total % 8 > 0)
    slots = [tuple(r) for r in mix.slots.select("source_no", "slot").collect()]
    by = {}
    for source, slot in slots:
        by.setdefault(source, []).append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_offsets_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 5)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 4)
    rows = mixing.Mix(documents(spark)).docs.where("size > 0").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_no, []).append((r.start, r.size))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def documents(spark):
    rows = [(i, prose(20 + i % 90, i), ["a", "b", "c", None][0 if i % 3 == 0 else i % 4], "en") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_report(spark):
    docs = documents(spark)
    rows = mixing.mix_report(mixing.Mix(docs)).collect()
    assert len(rows) == 600 and all(r.taken <= 3 * r.size for r in rows)
    sizes = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert all(r.size == sizes[r.doc_id] for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault((r.source_size, r.target), [0])
        s[0] += r.taken
    assert len(by) == 4 and all(abs(taken - target) <= max(64, 0.01 * target) for (_, target), (taken,) in by.items())
    again = mixing.mix_report(mixing.Mix(docs.repartition(7))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_brute_force(spark):
    """Blocks built word by word, slots mapped one by one."""
    docs = documents(spark)
    mix = mixing.Mix(docs, block_words=16)
    uses = {}
    for r in mix.slots.collect():
        uses[r.source_no, r.block] = uses.get((r.source_no, r.block), 0) + 1
    want = {}
    for r in mix.docs.collect():
        want[r.id] = sum(uses.get((r.source_no, w // 16), 0) for w in range(r.start, r.start + r.size))
    assert {r.doc_id: r.taken for r in mixing.mix_report(mix).collect()} == want
    starts = sorted((r.source_no, r.start, r.size) for r in mix.docs.collect())
    for (s, a, n), (s2, b, _) in zip(starts, starts[1:]):
        assert s != s2 or a + n == b  # documents fill their source without gaps


def test_documents_of_the_mix(spark):
    docs = documents(spark)
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    words = {}
    for r in made.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixing.mix_report(mixing.Mix(docs)).collect() if r.taken}


def test_odd_rows(spark):
    for df in (odd(spark), clashing(odd(spark))):
        rows = mixing.mix_report(mixing.Mix(df)).collect()
        assert len(rows) == 13 and {r.doc_id: r.size for r in rows if r.doc_id in (4, 5, 6)} == {4: 0, 5: 0, 6: 0}
        made = mixing.mixed_documents(df)
        assert made.columns == df.columns and made.count() > 0
    assert mixing.mix_report(mixing.Mix(empty(spark))).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0
