"""Each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from riskspark.plans import registry


def rows(frame: pd.DataFrame) -> list[tuple]:
    show = lambda x: "" if x is None or x is pd.NaT or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    assert rows(registry.QUERIES[name](spark, data).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def repeated(data, tmp_path_factory):
    """The tables with articles that a run holds twice and three times, in other words and with other names."""
    at = tmp_path_factory.mktemp("repeated")
    for p in glob.glob(f"{data}/*.parquet"):
        if not p.endswith("/preprocessed_articles.parquet"):
            os.symlink(p, at / os.path.basename(p))
    # The further names come last, so that no two share a place.
    again = "title || ' at Nalyalfield' as title, 'A storm shut roads. ' || coalesce(clean_body, '') as clean_body, list_concat(coalesce(matched_entities, []), ['the Zed Port']) as matched_entities"
    c = duckdb.connect()
    c.execute(f"create table p as select * from '{data}/preprocessed_articles.parquet'")
    c.execute(f"insert into p select * replace ({again}) from p where article_id % 3 = 0")
    c.execute("insert into p select * from p where article_id % 6 = 0")
    c.execute(f"copy p to '{at}/preprocessed_articles.parquet' (format parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["corpus_records", "ner_fusion"])
def test_repeated_articles_equal_sql(spark, repeated, name):
    c = duckdb.connect()
    for p in glob.glob(f"{repeated}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert rows(registry.QUERIES[name](spark, repeated).toPandas()) == rows(c.sql(registry.ORACLES[name]).df())
