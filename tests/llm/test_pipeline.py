import corpus_pipeline as pipeline
import pytest
from conftest import SMALL
from helpers import empty, odd, prose
from test_substrings import words


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= seen, name
        docs, seen = out, now
    last = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0


@pytest.mark.parametrize("rows", [odd, empty])
def test_odd_rows(spark, rows):
    for name, stage in pipeline.STAGES:
        stage(spark, rows(spark), SMALL).collect()


def test_copies_and_passages_go_and_clean_documents_stay(spark):
    from pyspark.sql import functions as F

    base, shared = {i: words(200, i) for i in range(30)}, words(60, 999)
    rows = [(i, base[i]) for i in range(20)] + [(100, base[0]), (101, base[1].replace(" ", "  ", 3)), (102, " ".join(w if k % 90 else "changed" for k, w in enumerate(base[2].split())))]
    rows += [(20 + i, base[20 + i] + "\n" + shared + "\n" + words(50, 500 + i)) for i in range(3)] + [(200, "12 34"), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    told = pipeline.by_language(spark, docs, "")
    assert {r.doc_id for r in told.collect()} == {i for i, _ in rows} - {200, 201}
    kept = pipeline.without_near_duplicates(spark, told, "")
    assert {r.doc_id for r in kept.collect()} == set(range(23))
    cut = {r.doc_id: r.text for r in pipeline.without_repeats(spark, kept, "").collect()}
    assert set(cut) == set(range(23)) and all(cut[i] == base[i] for i in range(20)) and shared in cut[20]
    assert all(len(cut[i].split()) < 200 + 50 + 35 for i in (21, 22))
    assert prose(3, 1)
