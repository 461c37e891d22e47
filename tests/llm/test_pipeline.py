"""The pipeline's stages on small tables, and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from gleaner.llm import queries


def test_stages_keep_the_columns_and_do_their_part(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    rejected = {r.doc_id for r in queries.op2_quality(spark, sf).where("predicted = 0").collect()}
    good = corpus_pipeline.keep_good(spark, docs, sf).cache()
    assert good.columns == columns and {r.doc_id for r in good.collect()}.isdisjoint(rejected) and good.count() + len(rejected) == before
    single = corpus_pipeline.keep_one_of_each(spark, good, sf).cache()
    assert single.columns == columns and single.count() <= good.count()
    cut = corpus_pipeline.cut_repeats(spark, single, sf).cache()
    assert cut.columns == columns and cut.count() == single.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = corpus_pipeline.mix(spark, cut, sf).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in cut.collect()}
    encoded = corpus_pipeline.encode(spark, mixed, sf).collect()
    assert len(encoded) == mixed.count() and all(r.n_tokens == len(r.ids) for r in encoded)


def test_odd_documents_pass_through(spark, sf, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "word " * 30000, "en", "s", 150000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, part, sf)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.encode(spark, part, sf).collect()


def test_clashing_columns_stay(spark, sf):
    names = ["score", "n_words", "n_removed", "kept", "copies", "copy", "order_key", "node", "id", "text_hash", "first"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *[f"concat('{c}-', doc_id) AS {c}" for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in names)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    theirs = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=str)
    assert mine == theirs
