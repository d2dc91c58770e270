"""The hash store, the manifest, whole-table hashes, own sniffers and the table function."""

import hashlib
import io
import os
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from bytelake import sources
from bytelake.operators import hashing, machine, sniff
from bytelake.plans import queries
from bytelake.sources import blobs_from_column, manifest, scan_corpus, store

DIR = "/root/testdata/sf0.001"


def files(spark, rows):
    return spark.createDataFrame([(p, p.split("/")[-1], len(c), t, bytearray(c)) for p, t, c in rows], "path string, name string, length long, t long, content binary").withColumn("time", F.timestamp_seconds("t")).drop("t")


def test_crc32_of_all_documents(spark):
    rows = {r.name: r for r in hashing.content_hashes(queries.documents(spark, DIR)).collect()}
    texts = {str(r.doc_id): (r.text or "").encode() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    assert all((rows[k].crc32, rows[k].sha1, rows[k].md5) == (f"{zlib.crc32(t):08x}", hashlib.sha1(t).hexdigest(), hashlib.md5(t).hexdigest()) for k, t in texts.items())
    table = hashing.hash_table(queries.documents(spark, DIR))
    assert {(r.name, r.hash) for r in table.where("algo = 'crc32'").collect()} == {(k, f"{zlib.crc32(t):08x}") for k, t in texts.items()}


def test_store_takes_what_is_new(spark, tmp_path):
    s = store.HashStore(spark, str(tmp_path / "s"), 4)
    asked = spark.createDataFrame([(hashlib.md5(x).hexdigest().upper(),) for x in (b"a", b"b", b"c")] + [(None,)], "hash string")
    names = lambda s: {r.hash: r.names for r in s.find("md5", asked).collect()}
    of = lambda **k: {hashlib.md5(x.encode()).hexdigest(): v for x, v in k.items()}
    assert names(s) == of(a=[], b=[], c=[])
    first = files(spark, [("d/1", 5, b"a"), ("d/2", 5, b"b"), ("d/3", 5, b"a"), ("d/3", 5, b"a")])
    assert s.merge(first) == 3 and s.merge(first) == 0
    assert names(s) == of(a=["1", "3"], b=["2"], c=[])
    assert s.merge(files(spark, [("d/3", 6, b"c"), ("d/2", 5, b"b"), ("e/4", 1, b"c")])) == 2  # changed, the same, new
    assert names(s) == of(a=["1"], b=["2"], c=["3", "4"])
    s.forget(spark.createDataFrame([("d/1",)], "path string"))
    before = names(s)
    assert before == of(a=[], b=["2"], c=["3", "4"]) and s.hashes().count() == 9 and s.rows().count() == 15
    s.compact()
    assert names(s) == before and s.rows().count() == 9
    again = store.HashStore(spark, str(tmp_path / "s"), 99)
    assert again.buckets == 4 and names(again) == before and again.merge(files(spark, [("f/5", 1, b"b")])) == 1
    s.compact()
    assert names(s) == of(a=[], b=["2", "5"], c=["3", "4"])


def test_lookups_leave_the_store_where_it_is(spark, tmp_path):
    s = store.HashStore(spark, str(tmp_path / "s"), 8)
    s.merge(files(spark, [(f"d/{i}", 5, b"%d" % (i % 7)) for i in range(50)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("hash"))
        met = s.rows().where("algo = 'md5'").join(asked.distinct(), "hash", "left_semi")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("Join") :].split("FileScan")[0]  # from the join down to the store's scan
    assert "Exchange" not in scan and "Bucketed: true" in plan, plan
    assert met.count() == 50


def test_a_hash_with_a_million_names(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select(F.lit("h").alias("hash"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit("md5").alias("algo"))
    found = hashing.find_by_hash(rows, "md5", spark.createDataFrame([("H",), ("none",)], "hash string"))
    got = found.select("hash", "chunk", "chunks", "copies", F.size("names").alias("k")).collect()
    mine = [r for r in got if r.hash == "h"]
    assert len(mine) == 100 and sum(r.k for r in mine) == n and max(r.k for r in mine) < 11_000 and {r.copies for r in mine} == {n}
    assert [(r.chunk, r.chunks, r.copies, r.k) for r in got if r.hash == "none"] == [(0, 1, 0, 0)]


def test_manifest_lists_what_changed(spark, tmp_path, monkeypatch):
    corpus = tmp_path / "c"
    for d in ("a/x", "a/y", "b", "e"):
        os.makedirs(corpus / d)
    for p in ("a/1.prg", "a/x/2.prg", "a/y/3.prg", "b/4.prg", ".hidden", "b/_skip"):
        (corpus / p).write_bytes(p.encode())
    old = 1_700_000_000
    for d, _, names in os.walk(corpus):
        for x in ["", *names]:
            os.utime(os.path.join(d, x), (old, old))
    m = manifest.Manifest(spark, str(corpus), str(tmp_path / "m"))
    short = lambda df: sorted(r.path.removeprefix(f"{corpus}/") for r in df.collect())
    assert short(m.update()) == ["a/1.prg", "a/x/2.prg", "a/y/3.prg", "b/4.prg"]
    assert m.dirs().where("listed").count() == 6
    assert short(m.update()) == [] and m.dirs().where("listed").count() == 0 and m.dirs().count() == 6
    (corpus / "a/y/5.prg").write_bytes(b"five")
    os.remove(corpus / "b/4.prg")
    os.makedirs(corpus / "b/z")
    (corpus / "b/z/6.prg").write_bytes(b"")
    (corpus / "a/1.prg").write_bytes(b"in place")
    assert short(m.update()) == ["a/y/5.prg", "b/z/6.prg"]
    assert sorted(r.dir.removeprefix(f"{corpus}") for r in m.dirs().where("listed").collect()) == ["/a/y", "/b", "/b/z"]
    assert short(m.files()) == ["a/1.prg", "a/x/2.prg", "a/y/3.prg", "a/y/5.prg", "b/z/6.prg"]
    assert short(m.update(again=True)) == ["a/1.prg"] and short(m.files(1)) == ["a/1.prg", "a/x/2.prg", "a/y/3.prg", "b/4.prg"]
    content = {r.name: bytes(r.content) for r in manifest.read_content(m.files()).collect()}
    assert content == {"1.prg": b"in place", "2.prg": b"a/x/2.prg", "3.prg": b"a/y/3.prg", "5.prg": b"five", "6.prg": b""}
    assert {k: v for k, v in content.items() if v} == {r.name: bytes(r.content) for r in scan_corpus(spark, str(corpus)).collect()}
    os.remove(corpus / "a/x/2.prg")
    assert "2.prg" not in {r.name for r in manifest.read_content(m.files(1)).collect()}
    # What is new goes to the store.
    s = store.HashStore(spark, str(tmp_path / "s"), 2)
    assert s.merge(manifest.read_content(m.files())) == 4
    assert short(manifest.Manifest(spark, str(corpus / "nowhere"), str(tmp_path / "n")).update()) == []


def test_own_sniffers(spark):
    blobs = blobs_from_column(spark.createDataFrame([("1", bytearray(b"hello")), ("2", bytearray(b"\x00\xa0")), ("3", bytearray(b"x")), ("4", None)], "id string, b binary"), "id", "b")
    own = {"shy": ("basic", lambda b: b.where("blob_id = '1'").select("blob_id", F.lit(9).alias("score"), F.array(F.lit("said")).alias("messages"))), "null": ("code", lambda b: b.select("blob_id", F.lit(None).alias("score"), F.lit(None).alias("messages")))}
    rows = sniff.sniff_with(blobs, sniff.column_sniffers() | own)
    assert rows.where("sniffer = 'shy'").first().messages == ["said"] and rows.where("sniffer = 'null' AND score != 0").count() == 0
    got = {r.blob_id: (r.type, r.sniffer) for r in sniff.classify_type(rows).collect()}
    assert got["1"] == ("basic", "shy") and got["2"] == ("code", "prg@a000") and got["3"][0] == got["4"][0] == "unknown"
    assert sniff.sniff_with(blobs.limit(0), sniff.column_sniffers()).count() == 0


def test_table_function(spark):
    blobs = blobs_from_column(spark.createDataFrame([("1", bytearray.fromhex("0010a9018d009060")), ("2", bytearray(b"")), ("3", None)], "id string, b binary"), "id", "b")
    machine.register(spark, "swept")
    blobs.createOrReplaceTempView("swept_blobs")
    got = spark.sql("SELECT b.blob_id, i.* FROM swept_blobs b, LATERAL swept(b.content) i").collect()
    want = machine.instruction_table(blobs).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3


def test_entries_of_many_archives_are_sent_back_in_parts(spark, monkeypatch):
    seen = []

    class Tapped:
        def where(self, _):
            return self

        def mapInPandas(self, helper, _):
            seen.append(helper)
            return self

        unionByName = where

    monkeypatch.setattr(sources, "SENT_BYTES", 1_000)
    sources.expand_zips(Tapped())
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(5):
            z.writestr(f"{i}.txt", bytes([65 + i]) * 400)
    rows = [(f"a{k}.zip", f"a{k}.zip", f"a{k}.zip", 0, held.getvalue(), None) for k in range(20)]
    parts = list(seen[0](iter([pd.DataFrame(rows, columns=["blob_id", "name", "path", "length", "content", "label"])])))
    assert max(p["length"].sum() for p in parts) <= 1_400
    assert [p for x in parts for p in x["path"]] == [f"a{k}.zip#{i}.txt" for k in range(20) for i in range(5)]
