"""Operators on literal bytes, against worked values and small models in plain Python."""

import hashlib
import io
import math
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.functions import base64_decode, base64_encode, hex_bytes
from bytelake.operators import classifier, features, grams, hashing, inventory, signatures, stats
from bytelake.sources import BLOBS, blobs_from_column, expand_zips, filter_corpus, hash_store, load_hashes, ok_ext, read_labelled, save_hashes, scan_corpus

A = bytes.fromhex("010201020103")
D2 = bytes.fromhex("01020304")


def blobs(spark, contents, labels=None):
    rows = [(f"b{i}", f"n{i}.prg", f"/x/n{i}.prg", len(c), bytearray(c), (labels or {}).get(i)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, BLOBS)


def values(df):
    return {r.feature: r.value for r in df.collect()}


def test_gram_values(spark):
    two = blobs(spark, [A, D2])
    counts = grams.gram_counts(two, 2)
    got = {(r.blob_id, r.gram): (r.cnt, r.first_pos) for r in grams.ngram_counts(two, 2).collect()}
    assert got["b0", "01_02"] == (2, 0) and got["b0", "02_01"] == (2, 1) and got["b0", "01_03"] == (1, 4)
    s = grams.ngram_summary(counts).where("blob_id = 'b0'").first()
    assert (s.ngram_total_count, s.ngram_unique_count, s.ngram_diversity) == (5, 3, 0.6) and s.ngram_distribution == pytest.approx(0.36)
    e = [(r.packed, round(r.score, 6)) for r in grams.select_entropy(counts, 3).where("blob_id = 'b0'").orderBy("rank").collect()]
    assert e == [(0x0102, 0.528771), (0x0201, 0.528771), (0x0103, 0.464386)]
    df = grams.document_frequencies(counts)
    t = [(r.packed, round(r.score, 6)) for r in grams.select_tfidf(counts, df, 2, 3).where("blob_id = 'b0'").orderBy("rank").collect()]
    assert t == [(0x0201, 1.405465), (0x0102, 1.0), (0x0103, 0.702733)]
    v = [(r.packed, r.variance) for r in grams.select_variance(counts, 2, 5).collect()]
    assert v[0] == (0x0201, 1.0) and {x for _, x in v[1:]} == {0.25}
    with pytest.raises(ValueError):
        grams.gram_counts(two, 0)
    assert grams.gram_counts(blobs(spark, [b"", b"a"]), 2).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_helper_equals_builtin(spark, n):
    rng = np.random.default_rng(n)
    some = blobs(spark, [rng.integers(0, 4, k).astype(np.uint8).tobytes() for k in (0, 1, 2, 6, 7, 50, 300)])
    key = lambda df: sorted((r.blob_id, r.packed, r.cnt, r.first_pos, r.total) for r in df.collect())
    assert key(grams.gram_counts(some, n)) == key(grams.gram_counts_builtin(some, n))
    total = {r.blob_id: r.total for r in grams.ngram_stats(some, n).collect()}
    assert [total[f"b{i}"] for i in range(7)] == [max(0, k - n + 1) for k in (0, 1, 2, 6, 7, 50, 300)]


def test_entropy_and_histogram(spark):
    same = blobs(spark, [bytes([66] * 5)])
    assert len(values(stats.entropy_features(same))) == 5
    v = values(stats.entropy_features(same, window=3))
    assert v["global_entropy"] < 0.01 and v["max_window_entropy"] < 0.01
    h = values(stats.histogram(blobs(spark, [bytes([0, 0, 0, 0, 255])])))
    assert len(h) == 256 and h["b_0"] == 0.8 and h["b_255"] == 0.2 and sum(h.values()) == pytest.approx(1)
    h = values(stats.histogram(blobs(spark, [bytes([0, 2, 4, 8, 4, 2, 0, 8])])))
    assert h["b_2"] == h["b_0"] == 0.25
    empty = values(stats.entropy_features(blobs(spark, [b""])))
    assert empty["global_entropy"] == 0 and empty["min_window_entropy"] == math.inf and math.isnan(empty["std_window_entropy"])
    assert all(math.isnan(x) for x in values(stats.histogram(blobs(spark, [b""]))).values())
    assert stats.histogram(blobs(spark, [b""]), "drop").count() == 0
    assert values(stats.entropy_features(blobs(spark, [A])))["global_entropy"] == pytest.approx(1.459148, abs=1e-6)


def test_lengths_and_bigrams(spark):
    v = values(stats.length_features(blobs(spark, [bytes(512)])))
    assert len(v) == 11 and v["root_length_1024k"] == pytest.approx(0.022097, abs=1e-6) and v["root_length_2k"] == 0.5
    f = values(stats.bigram_features(blobs(spark, [A]), top=2))
    assert f == {"bigram_total_count": 4, "bigram_01_02": 2, "bigram_01_02_norm": 0.5, "bigram_02_01": 2, "bigram_02_01_norm": 0.5, "bigram_unique_count": 3, "bigram_distribution": 9 / 16}
    assert stats.bigram_features(blobs(spark, [b"a"])).count() == 0
    grid = stats.bigram_grid(blobs(spark, [A]))
    assert grid.count() == 65536 and grid.agg(F.sum("cnt")).first()[0] == 5
    assert {(r.first, r.second): r.intensity for r in stats.bigram_intensity(blobs(spark, [A])).collect()}[1, 3] == round(255 * 0.5**0.25)
    r = stats.bigram_range(blobs(spark, [A])).first()
    assert (r.max_count, r.min_count, r.ref_min) == (2, 1, 1)


def test_markov(spark):
    counts = stats.corpus_markov(blobs(spark, [A, D2, b"", b"\x01"]))
    got = {(r.kind, r.first, r.second): r.cnt for r in counts.collect()}
    assert got["start", 1, None] == 3 and got["stop", 3, None] == 1 and got["pair", 1, 2] == 3
    m = stats.markov_matrix(counts).collect()
    assert len(m) == 258 and all(len(r.counts) == 256 for r in m) and m[0].counts[1] == 3 and m[2].counts[2] == 3 and m[257].counts[4] == 1


def test_hashes_and_text_forms(spark, tmp_path):
    data = bytes.fromhex("01100510000099000000")
    two = blobs(spark, [data, data, b"x"])
    r = hashing.content_hashes(two).first()
    assert (r.sha1, r.md5, r.crc32) == ("6a2899178d340c7776af16224945d0782f890d3d", "518758ddf25e32587a6732700d69959d", "4ffe7dbd")
    table = hashing.hash_table(two)
    asked = spark.createDataFrame([(r.md5.upper(),), ("0" * 32,)], "hash string")
    found = {x.hash: x.names for x in hashing.find_by_hash(table, "md5", asked).collect()}
    assert found == {r.md5: ["n0.prg", "n1.prg"], "0" * 32: []}
    with pytest.raises(ValueError):
        hashing.find_by_hash(table, "sha256", asked)
    d = hashing.duplicate_groups(table).collect()
    assert sorted((x.name, x.copies) for x in d) == [("n0.prg", 2), ("n1.prg", 2)]
    save_hashes(table, str(tmp_path / "h"), text=True)
    back, head = load_hashes(spark, str(tmp_path / "h/text/crc32"), "crc32")
    assert {(x.name, x.hash) for x in back.collect()} == {("n0.prg", "4ffe7dbd"), ("n1.prg", "4ffe7dbd"), ("n2.prg", f"{zlib.crc32(b'x'):08x}")}
    assert head["count"] == "3" and head["version"] == "2"
    assert hash_store(two, str(tmp_path / "s")).count() == 9 and hash_store(two.limit(0), str(tmp_path / "s")).count() == 9
    text = spark.createDataFrame([(bytearray(b"this text is input to base64 encoding"),), (bytearray.fromhex("DEADBEEFCAFEBABE"),)], "c binary")
    e = [x[0] for x in text.select(base64_encode("c")).collect()]
    assert e == ["dGhpcyB0ZXh0IGlzIGlucHV0IHRvIGJhc2U2NCBlbmNvZGluZw==", "3q2+78r+ur4="]
    odd = spark.createDataFrame([("3q2+ 78r+\nur4",), ("",), ("!",)], "s string").select(base64_decode("s")).collect()
    assert [bytes(x[0]) for x in odd] == [bytes.fromhex("DEADBEEFCAFEBABE"), b"", b""]
    assert text.select(hex_bytes("c")).collect()[1][0] == "de ad be ef ca fe ba be"
    assert hashlib.sha1(data).hexdigest() == r.sha1


def test_sources(spark, tmp_path):
    for name, data in {"c64/a.prg": b"abc", "c64/.hidden": b"x", "vic20/a.prg": b"de", "vic20/b.TXT": b"text", "vic20/empty": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = scan_corpus(spark, str(tmp_path))
    assert sorted(r.name for r in files.collect()) == ["a.prg", "a.prg", "b.TXT"]
    assert sorted(r.length for r in filter_corpus(files).collect()) == [2, 3]
    got = read_labelled(spark, str(tmp_path))
    assert Counter(r.label for r in got.collect()) == {"vic20": 2, "c64": 1}
    assert {r.blob_id for r in read_labelled(spark, str(tmp_path), dedupe_ids=True).collect()} == {"c64_a.prg", "vic20_a.prg", "vic20_b.TXT"}
    names = spark.createDataFrame([("Makefile",), ("makefile",), ("x.makefile",), ("a.vcxproj.user",), ("tap",), ("tape",), (None,)], "name string")
    assert [r[0] for r in names.select(ok_ext("name")).collect()] == [False, True, False, False, False, True, False]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/", "")
        z.writestr("d/in.prg", b"inner")
    rows = [("z", "a.ZIP", "/a.ZIP", 1, bytearray(buffer.getvalue()), "l"), ("y", "bad.zip", "/bad.zip", 1, bytearray(b"no"), None), ("x", "p.prg", "/p.prg", 1, bytearray(b"p"), None)]
    out = {r.path: bytes(r.content) for r in expand_zips(spark.createDataFrame(rows, BLOBS)).collect()}
    assert out == {"/a.ZIP#d/in.prg": b"inner", "/p.prg": b"p"}
    text = blobs_from_column(spark.createDataFrame([(1, "é"), (2, None)], "id int, t string"), "id", "t")
    assert [r.length for r in text.collect()] == [2, 0]
    assert [r.mib for r in inventory.large_files(files, 2).collect()] == ["0.000", "0.000"]
    assert inventory.corpus_count(files).first().files == 3 and {r.extension for r in inventory.extension_inventory(files).collect()} == {"prg"}
    assert inventory.sample_per_class(got, 1).count() == 2


def test_signatures(spark):
    assert len(signatures.BASIC) == 11 and len(signatures.ENHANCED) == 52
    some = blobs(spark, [bytes.fromhex("01080b080a009e32303631"), bytes.fromhex("0110aaaa"), b"\xc7\x00\x00\x00", b"\x00", b"AD"])
    hit = {}
    for r in signatures.matches(some).collect():
        hit.setdefault(r.blob_id, set()).add(r.name)
    assert hit["b0"] == {"c64_prg_basic"} and hit["b1"] == {"vic20_prg_unexpanded"} and hit["b2"] == {"c64_cartridge_header"} and "b3" not in hit
    best = {r.blob_id: (r.platform, r.code) for r in signatures.dominant_platform(signatures.platform_scores(signatures.matches(some))).collect()}
    assert best["b0"] == ("c64", 1.0) and best["b1"] == ("vic20", 0.0)
    v = values(signatures.signature_features(some.where("blob_id = 'b0'")))
    assert v["signature_c64_prg"] == 1 and v["signature_match_count"] == 1 and len(v) == 12
    v = values(signatures.enhanced_signature_features(some.where("blob_id = 'b0'")))
    assert v["signature_c64_prg_basic"] == 0.8 and v["signature_platform_c64"] == 0.8 and v["signature_dominant_platform"] == 1.0
    v = values(signatures.load_address_features(some.where("blob_id = 'b0'")))
    assert round(v["load_addr_value"], 6) == 0.031265 and v["load_addr_c64_similarity"] == 1.0 and round(v["load_addr_vic20_similarity"], 6) == 0.984375
    assert v["load_addr_platform_ratio"] == 0.5078125 and v["load_addr_has_basic_token"] == 1
    assert values(signatures.load_address_features(some.where("blob_id = 'b3'")))["load_addr_platform_ratio"] == 0.5
    mine = signatures.add_signature((), signatures.Signature("m", b"AB", 0, b"\xf0\x00"))
    assert [r.blob_id for r in signatures.matches(blobs(spark, [b"AB", b"OB", b"AC"]), mine).collect()] == ["b0", "b1"]
    acc = {r.label: (r.total, r.correct) for r in signatures.signature_accuracy(some.withColumn("label", F.lit("c64"))).collect()}
    assert acc["c64"] == acc[None] == (5, 2)
    assert signatures.signature_report(signatures.matches(some)).count() >= 3


def test_structure(spark):
    chain = bytearray(40)
    chain[2:4], chain[10:12], chain[20:22] = b"\x0a\x00", b"\x14\x00", b"\x00\x00"
    back = bytearray(40)
    back[2:4] = b"\x01\x00"
    v = [values(signatures.structure_features(blobs(spark, [bytes(c)]))) for c in (chain, back, b"\x8d\x00\x90\x00\x00", b"\x00\x8d\x00\x90")]
    assert (v[0]["signature_valid_basic_structure"], v[0]["signature_basic_line_count"]) == (1, 0.2)
    assert v[1]["signature_valid_basic_structure"] == 0
    assert v[2]["signature_has_vic_registers_access"] == 0.5 and v[3]["signature_has_vic_registers_access"] == 0


def test_pipelines(spark):
    assert [len(features.preset(p).extractors) for p in ("full", "ngram", "signature", "streamlined", "default", "balanced", "?")] == [6, 5, 1, 8, 8, 7, 6]
    p = features.FeaturePipeline().add(features.ngram_extractor(2, 2)).add(features.ngram_extractor(3, 2))
    rows = features.resolve_features(p.extract(blobs(spark, [A])))
    assert values(rows)["ngram_total_count"] == 4 and values(rows)["ngram_01_02"] == 2
    assert "ngram(2, 2, frequency)" in p.describe()
    assert [r.feature for r in features.top_features(rows, 1).collect()] == ["ngram_total_count"]
    assert features.resolve_features(features.preset("full").extract(blobs(spark, [A]))).count() > 300
    own = lambda df: df.selectExpr("blob_id", "0 AS emit_idx", "'len' AS feature", "CAST(length AS DOUBLE) AS value")
    assert values(features.FeaturePipeline([own]).extract(blobs(spark, [A]))) == {"len": 6.0}


def test_classifier(spark, tmp_path):
    data = {"a": {"x": 0, "y": 2}, "b": {"x": 4}, "c": {"x": 2, "y": 6, "z": 5}}
    feats = spark.createDataFrame([(b, f, float(v)) for b, fs in data.items() for f, v in fs.items()], "blob_id string, feature string, value double")
    labels = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "vic20")], "blob_id string, label string")
    model = classifier.train_ensemble(feats, labels)
    assert {r.label: r.weight for r in model.classes.collect()} == {"p": 1.0, "vic20": 3.0}
    model.save(str(tmp_path / "m"))
    scores = classifier.class_scores(feats, labels, classifier.Model.load(spark, str(tmp_path / "m")))
    got = {(r.blob_id, r.label): round(r.score, 6) for r in scores.collect()}
    assert got == {("a", "p"): 0.686608, ("a", "vic20"): 0.940176, ("b", "p"): 0.747887, ("b", "vic20"): 0.756338, ("c", "p"): 0.0, ("c", "vic20"): 3.0}
    told = classifier.predict(scores)
    assert {r.predicted for r in told.collect()} == {"vic20"} and told.first().all_scores.keys() == {"p", "vic20"}
    assert classifier.ranked_scores(scores).where("rank = 1").count() == 3
    judged = told.join(labels, "blob_id").select(F.col("label").alias("actual"), "predicted")
    confusion = classifier.confusion_matrix(judged, model.classes)
    assert {(r.actual, r.predicted): r.cnt for r in confusion.collect()} == {("p", "p"): 0, ("p", "vic20"): 2, ("vic20", "p"): 0, ("vic20", "vic20"): 1}
    m = {r.label: r for r in classifier.evaluate(confusion).collect()}
    assert m["p"].precision == m["p"].f1 == 0 and m["vic20"].recall == 1 and m["vic20"].accuracy == pytest.approx(1 / 3)
    text = classifier.render_report(classifier.evaluate(confusion), confusion, "run")
    assert "33.33%" in text
    classifier.append_report(spark, str(tmp_path / "r"), text, pipeline="full")
    classifier.append_report(spark, str(tmp_path / "r"), text)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_split(spark):
    labels = spark.range(103).selectExpr("id AS blob_id", "CASE WHEN id < 3 THEN 'few' ELSE 'many' END AS label")
    rows = classifier.stratified_split(labels, 0.2, 1).collect()
    assert Counter((r.label, r.test) for r in rows) == {("few", True): 1, ("few", False): 2, ("many", True): 20, ("many", False): 80}
    assert {r.blob_id for r in rows if r.test} == {r.blob_id for r in classifier.stratified_split(labels, 0.2, 1).collect() if r.test}
