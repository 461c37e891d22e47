"""Every registered query that SQL can express equals it; the others run."""

import os

import duckdb
import pytest

import __spark_entry__
from gleaner.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in catalog.ORACLES:
        theirs = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        assert mine == sorted((tuple(map(plain, r)) for r in theirs), key=str)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["ord", "query", "url", "site", "score"] and df.count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_quotes_and_read_more_stay(spark, tmp_path):
    spark.createDataFrame([(1, 'find "a b" c'), (2, "plain words"), (3, '"open end')], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    page = "<title>T</title><p>{}</p>"
    spark.createDataFrame([(2, "https://e.com/en/2", page.format("Some text...Read more")), (5, "https://e.com/en/5", page.format("Buy now Read more"))], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.item_id: (r.third, r.n) for r in rows("qrw1_tokens")} == {1: ("c", 3), 2: ("words", 2), 3: ('"open end', 1)}
    assert {r.kind: r["n"] for r in rows("qrw2_classify")} == {"quoted": 2, "plain": 4}
    assert {r.ord: r.snippet for r in rows("txt8_clean_snippet") if r.ord < 10} == {2: "Some text", 5: "Buy now"}
