"""Every core query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

from textgauge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, db, name):
    got = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["wer_total", "wer_split", "normalize_documents", "tokenize_documents", "bootstrap_ci", "utterance_scores"])
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_word_totals_are_those_of_the_split(spark):
    split = {(r.conv_id, r.turn): r.n_sub + r.n_del + r.n_ins for r in catalog.wer_split(spark, SMALL).collect()}
    assert split == {(r.conv_id, r.turn): r.errors for r in catalog.wer_total(spark, SMALL).collect()}


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.drop_failed(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan and "text" not in plan
