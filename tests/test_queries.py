"""Registered queries: names, SQL beside them, and a sample of them against DuckDB."""

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 46


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["blob_id", "gram", "cnt", "first_pos", "rank"] and rows.count() > 0


@pytest.mark.parametrize("name", ["duplicate_groups", "entropy_features", "select_tfidf", "evaluate", "corpus_markov"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    res = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(show(v) for v in r) for r in res.fetchall())
    assert sorted(tuple(show(r[c]) for c in names) for r in df.collect()) == want


def test_ngram_stats_of_short_texts(spark, tmp_path):
    rows = [(1, "abcabc", "en"), (2, "ab", "en"), (3, "", "fr"), (4, None, "fr"), (5, "xyz", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(entry.oracle_sql()["ngram_stats"])
    names = [c[0] for c in res.description]
    got = entry.queries()["ngram_stats"](spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(res.fetchall()) != []
