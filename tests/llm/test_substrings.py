import random

from helpers import PROSE, clashing, empty, odd, prose

from textgauge.llm import substrings


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + "".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 5))) for _ in range(n))


def test_cuts_follow_content():
    text = words(400, 1)
    a, b, n = substrings.chunks(text.encode())
    assert n.sum() == 400 and (n[1:-1] > substrings.REACH).all() and text[a[1] :].encode().startswith(text[a[1] : b[1]].encode())
    shifted = "some more words here " + text
    pieces = lambda t: {t.encode()[s:e] for s, e in zip(*substrings.chunks(t.encode())[:2])}
    assert len(pieces(text) & pieces(shifted)) >= len(pieces(text)) - 2
    for blank in (b"", b" \n"):
        assert len(substrings.chunks(blank)[0]) == 0


def plain_chunks(raw):
    """Word by word, with the hash computed anew for each."""
    starts = [i for i in range(len(raw)) if not raw[i : i + 1].isspace() and (i == 0 or raw[i - 1 : i].isspace())]

    def h(i):
        out = 0
        for byte in raw[max(0, i - substrings.WINDOW) : i]:
            out = (2 * out + int(substrings.GEAR[byte])) % (1 << 32)
        return out

    v = [1 << 33, *(h(i) for i in starts[1:])]
    at = lambda k: min(v[k], 0xFFFFFFFF) if 0 <= k < len(v) else 0xFFFFFFFF
    return [starts[k] for k in range(len(starts)) if k == 0 or all(at(k) < at(k - d) and at(k) <= at(k + d) for d in range(1, substrings.REACH + 1))]


def test_chunks_against_plain():
    for seed in range(20):
        raw = words(random.Random(seed).randint(1, 120), seed).replace(" ", "\n", seed % 3).encode()
        assert substrings.chunks(raw)[0].tolist() == plain_chunks(raw)


def planted(spark):
    rows = [(i, words(120, i)) for i in range(60)]
    passages = [words(55, 900 + k) for k in range(10)]
    for k, p in enumerate(passages):
        for doc in (k, 20 + k, 40 + k):
            i, t = rows[doc]
            cut = 200 + 7 * k
            at = t.index(" ", cut)
            rows[doc] = (i, t[:at] + "\n" + p + "\n" + t[at + 1 :])
    return spark.createDataFrame(rows, "doc_id long, text string"), passages


def test_planted_passages(spark):
    df, passages = planted(spark)
    spans = substrings.repeated_spans(df).collect()
    assert {(s.id, s.owner) for s in spans} == {(20 + k, k) for k in range(10)} | {(40 + k, k) for k in range(10)}
    text = {r.doc_id: r.text.encode() for r in df.collect()}
    for s in spans:
        found = text[s.id][s.first_byte : s.last_byte]
        assert found in passages[s.owner].encode() and len(found.split()) == s.n_words
    cut = {r.doc_id: r.text for r in substrings.drop_repeats(df).collect()}
    assert len(cut) == 60 and all(cut[i].encode() == text[i] for i in (*range(20), *range(30, 40), *range(50, 60)))
    assert all(len(cut[20 + k].split()) <= 120 + 35 for k in range(10))


def test_short_repeats_stay(spark):
    line = words(12, 77)
    df = spark.createDataFrame([(i, words(60, i) + "\n" + line + "\n" + words(60, 100 + i)) for i in range(10)], "doc_id long, text string")
    assert substrings.repeated_spans(df).count() == 0


def test_odd_rows(spark):
    for df in (odd(spark), clashing(odd(spark))):
        kept = substrings.drop_repeats(df)
        assert kept.columns == df.columns
        got = {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None}
        assert got[1] == prose(80, 1) and 3 not in got and got[4] is None and got[5] == "" and got[7] == prose(20_000, 5)
        assert kept.where("doc_id = 9").count() == 2  # one document in two rows is no repeat
        assert kept.where("doc_id is null").count() == 1  # the copy without an id goes, the row without a text stays
    assert substrings.drop_repeats(empty(spark)).count() == 0


def test_repeats_inside_a_document_on_demand(spark):
    passage = words(60, 501)
    rows = [(1, words(80, 1) + "\n" + passage + "\n" + words(80, 2) + "\n" + passage + "\n" + words(30, 3)), (2, words(90, 4) + "\n" + passage), (3, words(90, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {s.id for s in substrings.repeated_spans(df).collect()} == {2}
    spans = substrings.repeated_spans(df, inside=True).collect()
    assert sorted(s.id for s in spans) == [1, 2]
    second = rows[0][1].encode().rindex(passage.encode())
    assert all(s.first_byte >= second for s in spans if s.id == 1)


def test_a_few_words_over_and_over_are_cut(spark):
    for cycle in ("spam", "spam egg", "spam egg ham"):
        run = " ".join((cycle.split() * 60)[:60])
        rows = [(k, words(70, 10 * k) + "\n" + run + "\n" + words(70, 10 * k + 5)) for k in (1, 2)]
        spans = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [s.id for s in spans] == [2] and spans[0].n_words >= 40


def test_spans_against_all_pairs(spark):
    """Every run of words that a plain search finds in two documents, 51 words or longer, is reported but for its ends, and nothing else is."""
    df, _ = planted(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    split = {i: t.split() for i, t in texts.items()}
    grams, common = {}, {}
    for i in sorted(split):
        for at in range(len(split[i]) - 9):
            grams.setdefault(tuple(split[i][at : at + 10]), []).append((i, at))
    for places in grams.values():
        for i, at in places:
            if i != min(places)[0]:
                common.setdefault(i, set()).update(range(at, at + 10))
    found = {}
    for s in substrings.repeated_spans(df).collect():
        begin = len(texts[s.id].encode()[: s.first_byte].split())
        found.setdefault(s.id, set()).update(range(begin, begin + s.n_words))
    assert found.keys() == {i for i, at in common.items() if len(at) >= 51}
    assert all(at <= common[i] and len(at) >= len(common[i]) - 26 for i, at in found.items())


def test_rows_without_an_id_are_told_apart_whatever_their_short_hashes(spark):
    """Two texts that a 32-bit hash takes for one: what is cut from the one must not be cut from the other."""
    from pyspark.sql import functions as F

    passage, other = words(70, 1), words(150, 2)
    made = lambda start, name: spark.range(300_000).select(F.concat(F.lit(start + " "), F.col("id").cast("string")).alias(name)).withColumn("h", F.hash(name))
    pair = made(passage, "repeats").join(made(other, "alone"), "h").orderBy("repeats").first()
    assert pair is not None
    docs = spark.createDataFrame([(1, passage), (None, pair.repeats), (None, pair.alone)], "doc_id long, text string")
    kept = {r.text for r in substrings.drop_repeats(docs).collect()}
    assert pair.alone in kept and pair.repeats not in kept and passage in kept
    keys = docs.select(F.count_distinct(substrings._text_key("text")), F.count_distinct(F.hash("text"))).first()
    assert tuple(keys) == (3, 2)
