"""Documents that the first stage of the pipeline rejects and keeps."""

import random

import pytest

from bytelake.llm import language_id


def test_no_known_language_is_dropped(spark, rows):
    rng = random.Random(6)
    junk = {900: "12 345 -- 67 !!", 901: " ".join("".join(rng.choice("qxzjkvwy") for _ in range(7)) for _ in range(60)), 902: "\u0441\u043b\u043e\u0432\u043e \u0438 \u0434\u0435\u043b\u043e " * 9, 903: "\u2014 \u2026 \u2014", 904: None}
    known = [(r[0], r[1], r[2], "a") for r in rows[:60] if len(r[1]) > 60]
    docs = spark.createDataFrame([*known, *((k, t, "en", "a") for k, t in junk.items()), (None, "12", "en", "a")], "doc_id long, text string, lang string, source string")
    kept = [r.doc_id for r in language_id.keep_identified(docs).collect()]
    assert sorted(kept, key=lambda k: -1 if k is None else k) == [None, *(r[0] for r in known)]


def labelled(rows):
    return [(r[0], r[1], r[2]) for r in rows[:60] if len(r[1]) > 60]


def test_no_language_is_left_out(spark):
    """Twenty languages, each with words of its own; the rarest is learned like the others."""
    rng = random.Random(7)
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(20)}
    docs = [(k, " ".join(rng.choice(words[x]) for _ in range(60)), x) for i, x in enumerate(words) for k in range(100 * i, 100 * i + 3 + (i < 10) * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", " ".join(rng.choice(w) for _ in range(40))) for i, w in enumerate(words.values())], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in language_id.identify_pages(pages, df).collect()}
    assert got == dict(enumerate(words))
    with pytest.raises(ValueError):
        language_id.fit_text(df, most=19)


def test_host_counts_without_the_page_itself(spark, rows):
    """A page of one language alone on its host gains nothing from itself; pages without text follow their host."""
    known = spark.createDataFrame(labelled(rows), "doc_id long, text string, lang string")
    some = labelled(rows)
    fr = [t for _, t, x in some if x == "fr"][:5]
    pages = [(i, "http://fr.example.co.uk/", t) for i, t in enumerate(fr)] + [(10, "http://fr.example.co.uk/empty", ""), (11, "http://other.co.uk/", ""), (12, None, fr[0]), (12, None, fr[0])]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), known).collect()}
    assert got[10].lang == "und" and all(got[i].lang == "fr" for i in range(5)) and got[12].lang == "fr"
    assert got[12].host == ""


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 40").select("doc_id", "text", "lang")
    out = docs.where("crc32(CAST(doc_id AS STRING)) % 4 = 0")
    pages = out.selectExpr("doc_id AS page_id", "concat('http://h', doc_id, '.org/') AS url", "text AS html")
    got = language_id.identify_pages(pages, docs.where("crc32(CAST(doc_id AS STRING)) % 4 != 0")).join(out.selectExpr("doc_id AS page_id", "lang AS want"), "page_id").collect()
    assert len(got) > 20 and sum(r.lang == r.want for r in got) >= 0.95 * len(got)
