import random

import numpy as np
import pytest
import xxhash
from helpers import PROSE, clashing, empty, odd, prose
from pyspark.sql import functions as F

from textgauge.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one TWO", "a b c", "a b c a b c", "Ünï b c d\te", prose(300, 3), "x\x85y z w", "a\xa0b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == simhash.fingerprint("one two three")


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("distance,blocks,hot", [(2, 5, 256), (2, 4, 1), (2, 5, 3), (1, 3, 1), (0, 2, 1), (3, 6, 256)])
def test_links_against_all_pairs(spark, distance, blocks, hot):
    rng = random.Random(distance)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 6)):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = lambda a, b, d: bin((a ^ b) & (2**64 - 1)).count("1") <= d
    links = {(r.src, r.dst) for r in simhash.fingerprint_links(df, "fp", distance, blocks, hot).collect()}
    assert all(near(a, b, distance) for a, b in links)
    want = [(a, b) for a in fps for b in fps if a < b and near(a, b, distance)]
    assert union_find(links, fps) == union_find(want, fps)
    if hot >= 256:
        assert {tuple(sorted(x)) for x in links} == {tuple(sorted(x)) for x in want}


def test_one_hot_cluster(spark):
    """Hundreds of fingerprints under one key: linked through shared patterns, without all pairs."""
    rng = random.Random(4)
    fps = {0}
    while len(fps) < 400:
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(20)))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, hot=50)
    assert set(union_find([(r.src, r.dst) for r in links.collect()], fps).values()) == {0}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    nodes = list(range(300))
    rng.shuffle(nodes)
    pairs = list(zip(nodes[:120], nodes[1:121])) + [(nodes[150], n) for n in nodes[151:250]] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")).collect()}
    want = union_find(pairs, nodes)
    assert got == {n: c for n, c in want.items() if any(n in p for p in pairs if p[0] != p[1])}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_documents(spark):
    for df in (odd(spark), clashing(odd(spark))):
        got = simhash.near_duplicates(df).collect()
        assert len(got) == 13
        by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
        assert by[1] == by[3] == 1 and by[2] == 2 and by[4] == by[5] == by[6] == 4 and by[9] == 9
        assert sorted(r.component_id for r in got if r.doc_id is None) == [1, 4]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_similar_documents(spark):
    def edited(words, seed, n):
        rng = random.Random(seed)
        for i in rng.sample(range(len(words)), n):
            words = words[:i] + [f"new{i}"] + words[i + 1 :]
        return " ".join(words)

    rows = []
    for i in range(60):
        base = [random.Random(i * 1000 + j).choice(PROSE) + str(random.Random(i * 77 + j).randrange(50)) for j in range(150 + 10 * i)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, edited(base, i, max(1, len(base) // 60))), (3 * i + 2, prose(200, 5000 + i))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[3 * i + 1] == 3 * i for i in range(60)) >= 58
    assert all(got[3 * i] == 3 * i and got[3 * i + 2] == 3 * i + 2 for i in range(60))


def test_similar_documents_in_large_groups(spark):
    base = [f"w{j}" for j in range(300)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :])) for i, j in enumerate(np.random.default_rng(1).integers(0, 300, 300).tolist())]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), hot=16)
    assert {r.component_id for r in got.collect()} == {0}


def test_keep_first(spark):
    for df in (odd(spark), clashing(odd(spark))):
        kept = simhash.keep_first(df, simhash.similar_documents(df))
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert sorted(i for i in ids if i is not None) == [1, 2, 4, 7, 8, 9, 10] and ids.count(None) == 2
    assert simhash.keep_first(empty(spark), simhash.similar_documents(empty(spark))).count() == 0


def test_rows_that_share_an_id_but_no_text_are_not_lost(spark):
    a, b, c, d = (prose(90, seed) for seed in (21, 22, 23, 24))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, c), (4, c), (5, d), (6, d), (6, c + " y"), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_first(df, simhash.similar_documents(df)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (1, b), (4, c), (5, d), (0, c)])


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_components(rows):
    root = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in root}


def components_of(spark, rows, **how):
    return {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def test_similar_documents_are_those_of_similarity_0_8(spark):
    rng, rows = random.Random(5), []
    for i in range(150):  # n words and one more, or one less at either end: similarities on both sides of 0.8
        words = [f"d{i}w{j}" for j in range(6 + i % 20)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words, "more"])), (3 * i + 2, " ".join(["less", *words[1:]]))]
    for i in range(150, 210):
        words = [f"d{i}w{j}" for j in range(rng.randrange(60, 250))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 45)):
            other[at] = f"n{at}"
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(other))]
    want = brute_components(rows)
    assert 60 < sum(want[i] != i for i in want) < 300
    assert components_of(spark, rows) == want


@pytest.mark.parametrize("kind", ["loose", "mixed"])
def test_similar_documents_among_many_looser_variants(spark, kind):
    rng = random.Random(9)
    base = [f"w{j}" for j in range(300)]

    def variant(words, tag, n):
        out = list(words)
        for at in rng.sample(range(300), n):
            out[at] = f"{tag}x{at}" if kind == "loose" else f"y{at}"
        return out

    texts = [variant(base, f"v{i}", 24) for i in range(400)]
    planted = variant(base, "p", 24)
    texts[200:206] = [variant(planted, f"q{i}", 3) for i in range(6)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_components(rows)
    assert len({want[i] for i in range(200, 206)}) < 6 and len(set(want.values())) > 300
    assert components_of(spark, rows, hot=16) == want


def test_unlike_texts_that_chains_of_hot_keys_join_are_not_compared(spark, monkeypatch):
    rng = random.Random(11)
    passages = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(300)]
    dealt = [i % 300 for i in range(300 * 8)]
    rng.shuffle(dealt)
    texts = [" ".join(passages[k] for k in dealt[8 * i : 8 * i + 8]).split() for i in range(300)]  # a passage is in 8 texts
    for i in range(290, 300):
        texts[i] = [*texts[i - 290][:150], "new", *texts[i - 290][151:]]
    rows, fetched, written = [(i, " ".join(t)) for i, t in enumerate(texts)], [], simhash.written

    def noted(df, label):
        out = written(df, label)
        if label == "sets":
            fetched.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", noted)
    got = components_of(spark, rows, hot=4)
    assert got == brute_components(rows) and all(got[i] == i - 290 for i in range(290, 300))
    assert 20 <= sum(fetched) < 150  # not the family of all 300 that shared keys make up


def test_similar_documents_are_linked_through_blocks_of_their_fingerprints(spark, monkeypatch):
    candidates = simhash._candidates
    monkeypatch.setattr(simhash, "_candidates", lambda few: candidates(few).where("false"))  # nothing through prefixes
    rows = []
    for i in range(30):
        words = [f"d{i}w{j}" for j in range(800)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:400], "new", *words[401:]]))]
    prints = [int(simhash.set_fingerprint(simhash.shingle_set(t))[0]) for _, t in rows]
    close = {i for i in range(30) if ((prints[2 * i] ^ prints[2 * i + 1]) & (1 << 64) - 1).bit_count() <= 2}
    assert 5 <= len(close) < 30
    assert components_of(spark, rows) == {k: k - 1 if k % 2 and k // 2 in close else k for k, _ in rows}


def test_shingles_of_wanted_texts_are_made_once(spark, monkeypatch):
    seen, written = [], simhash.written

    def noted(df, label):
        if label == "sets":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(simhash, "written", noted)
    components_of(spark, [(i, prose(40, i % 5)) for i in range(20)])
    assert seen and all(plan.count("ArrowEvalPython [_keyed_sets") == plan.count("ArrowEvalPython [may_hold") == 1 for plan in seen)
