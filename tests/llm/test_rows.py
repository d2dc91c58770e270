"""Rows of one id with several texts, results held over other runs, clashing names, digits of any script, planted links."""

import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from bytelake.llm import common, decontaminate, embedding_dedup, jaccard_join, language_id, queries, substring_dedup, url_filter
from tests.llm.conftest import prose

ITEM = "which of the seven rivers named here runs through the old town before it meets the northern sea at last"


@pytest.fixture(scope="module")
def twice(spark):
    """doc_id 5 has a good text and, in turn, a near copy of document 1, a text without letters and a benchmark item."""
    rng = random.Random(3)
    texts = [prose(rng, "en", 90) for _ in range(12)]
    good, copy = texts[5], " ".join([*texts[1].split()[:-1], "other"])
    rows = [*enumerate(texts), (5, copy), (5, "12 34 -- 56"), (5, prose(rng, "en", 20) + ". " + ITEM), (None, copy)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "x", 2) for k, t in rows], "doc_id long, text string, lang string, source string, lost_id int, Spans string, span_of int")
    return docs, good, copy


def kept(df, k=5):
    return sorted(r.text for r in df.collect() if r.doc_id == k)


def test_other_texts_of_an_id_stay(spark, twice):
    docs, good, copy = twice
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    every = set(kept(docs))
    assert set(kept(language_id.keep_identified(docs))) == every - {"12 34 -- 56"}
    assert set(kept(jaccard_join.drop_near_copies(docs))) == every - {copy}
    left = decontaminate.drop_contaminated(docs, items)
    assert set(kept(left)) == {t for t in every if ITEM not in t} and left.columns == docs.columns
    assert kept(jaccard_join.drop_near_copies(docs), None) == [copy]
    assert sorted(r.doc_id or -1 for r in substring_dedup.remove_repeats(docs).collect()) == sorted(r.doc_id or -1 for r in docs.collect())


def test_results_outlive_a_run(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, prose(rng, "en", 60), "en", "s", 3) for i in range(12)]
    spark.createDataFrame(docs + [(20, docs[0][1], "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = queries.op8_ngram_jaccard_join(spark, str(tmp_path))
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    corpus_pipeline.known_language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    corpus_pipeline.one_of_near_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    assert held.count() == 13 and sorted(map(str, first.collect())) == sorted(map(str, second.collect())) and first.count() >= 12


def test_a_stage_called_alone_deletes_the_tables_of_the_one_before(spark, docs):
    common.release_all()
    corpus_pipeline.one_of_near_copies(spark, docs, "/nowhere").count()
    before = len(common._tables)
    corpus_pipeline.one_of_near_copies(spark, docs, "/nowhere").count()
    assert len(common._tables) == before
    corpus_pipeline._last.release()
    assert not common._tables


@pytest.mark.parametrize("one, other", [("12", "٣٤"), ("٣٤", "५६७"), ("12", "１２"), ("7", "x²"), ("½", "3")])
def test_numbers_of_any_script(spark, one, other):
    text = "a train leaves the station with {} red wagons and then needs some time until the small town behind the hills is reached"
    items = spark.createDataFrame([(1, text.format(one))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + text.format(other)), (2, "so " + text.format("nine"))], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.judge_documents(docs, items).collect()}
    assert got[1] and decontaminate.judge_documents(docs.limit(0), items).count() == 0


def test_the_join_removes_false_hits_of_the_filter(spark, monkeypatch):
    listed = spark.range(3000).selectExpr("concat('h/', id) AS canonical")
    asked = spark.range(2000, 6000).selectExpr("concat('h/', id) AS canonical")
    monkeypatch.setattr(url_filter, "BITS_A_URL", 1)  # nearly every bit is set
    got = url_filter.block_listed(asked, listed)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.canonical for r in got.where("listed").collect()} == {f"h/{i}" for i in range(2000, 3000)} and got.count() == 4000 and "Join" in plan


def test_planted_vectors_against_the_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 32))
    rows = [(i, (centres[i % 6] + 0.03 * rng.standard_normal(32)).tolist(), int(i % 6 > 3)) for i in range(60)]
    rows += [(100, rows[0][1], None), (101, [0.0] * 32, 0), (102, None, 0), (103, rows[0][1][:31] + [float("nan")], 0), (104, rows[3][1], rows[3][2]), (105, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embedding_dedup.SQL})").fetchall())
    assert sorted(map(tuple, embedding_dedup.near_vectors(df).collect())) == want and sum(r[1] > 0 for r in want) > 50


def test_an_id_is_one_node(spark):
    x, y = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    df = spark.createDataFrame([(1, x), (5, x[:2] + [0.11]), (5, y), (9, y[:2] + [0.11]), (12, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>").selectExpr("*", "'a' AS label")
    got = sorted((r.vec_id, r.component_id) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (9, 1), (12, 12)]
