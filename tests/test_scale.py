"""Paths for large blobs, large models and large vocabularies: the same rows as the plain ones."""

import math
import re
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytelake.operators import classifier, features, grams, machine, stats
from bytelake.sources import blobs_from_column

RNG = np.random.default_rng(3)
BLOBS = [b"", b"a", b"ab" * 300, bytes(700), RNG.integers(0, 256, 900, np.uint8).tobytes(), RNG.integers(0, 3, 1200, np.uint8).tobytes(), b"xyz" * 5 + bytes(range(256))]


@pytest.fixture(scope="module")
def blobs(spark):
    return blobs_from_column(spark.createDataFrame(list(enumerate(map(bytearray, BLOBS))), "id long, b binary"), "id", "b").repartition(3)


def plain(raw, n):
    first = {}
    for i in range(len(raw) - n + 1):
        first.setdefault(raw[i : i + n], i)
    return {g: (c, first[g]) for g, c in Counter(raw[i : i + n] for i in range(len(raw) - n + 1)).items()}


@pytest.mark.parametrize("chunk, part", [(1 << 20, 1 << 24), (64, 1 << 24), (64, 200)])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 9, 16, 33])
def test_chunks_and_parts_give_the_plain_counts(monkeypatch, n, chunk, part):
    monkeypatch.setattr(grams, "CHUNK", chunk)
    monkeypatch.setattr(grams, "PART", part)
    for raw in BLOBS:
        b, found = np.frombuffer(raw, np.uint8), {}
        for _, c, first in grams.counted_parts(b, n):
            for x, i in zip(c.tolist(), first.tolist(), strict=True):
                assert raw[i : i + n] not in found
                found[raw[i : i + n]] = (x, i)
        assert found == plain(raw, n)
        for strategy in ("frequency", "entropy"):
            (_, c, first), score, norm, distinct, squares = grams.best_of(b, n, 5, strategy)
            m = max(len(raw) - n + 1, 0)
            value = (lambda x: x) if strategy == "frequency" else (lambda x: round(-x / m * math.log2(x / m), 12))
            want = sorted(plain(raw, n).values(), key=lambda x: (-value(x[0]), x[1]))[:5]
            assert list(zip(c.tolist(), first.tolist(), strict=True)) == want and distinct == len(plain(raw, n))
            assert squares == pytest.approx(sum((x / m) ** 2 for x, _ in plain(raw, n).values()))


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_equal_hashes_are_told_apart(monkeypatch, chunk):
    monkeypatch.setattr(grams, "CHUNK", chunk)
    monkeypatch.setattr(grams, "hashed_grams", lambda b, n: np.zeros(max(len(b) - n + 1, 0), np.int64))
    for raw in BLOBS:
        parts = list(grams.counted_parts(np.frombuffer(raw, np.uint8), 9))
        assert {raw[i : i + 9]: (x, i) for _, c, first in parts for x, i in zip(c.tolist(), first.tolist(), strict=True)} == plain(raw, 9)


def test_windows_in_chunks(monkeypatch):
    want = [(stats.window_entropies(np.frombuffer(b, np.uint8), 7).tolist(), stats.entropy_values(np.frombuffer(b, np.uint8))[1]) for b in BLOBS]
    monkeypatch.setattr(stats, "CHUNK", 20)
    got = [(stats.window_entropies(np.frombuffer(b, np.uint8), 7).tolist(), stats.entropy_values(np.frombuffer(b, np.uint8))[1]) for b in BLOBS]
    assert repr(got) == repr(want)
    assert [len(w) for w, _ in want[:3]] == [0, 0, 86]  # 600 bytes: 85 windows, the rest of 5 counts


def test_small_batches_and_binary_grams(spark, blobs, monkeypatch):
    for n in (3, 8):
        monkeypatch.setattr(grams, "ROWS", 50)
        got = {(r.blob_id, bytes.fromhex(r.gram.replace("_", ""))): (r.cnt, r.first_pos) for r in grams.ngram_counts(blobs, n).collect()}
        assert got == {(str(i), g): x for i, raw in enumerate(BLOBS) for g, x in plain(raw, n).items()}
        other = grams.gram_counts_builtin(blobs, n)
        assert sorted(map(str, other.select("blob_id", "packed", "cnt", "first_pos", "total").collect())) == sorted(map(str, grams.gram_counts(blobs, n).select("blob_id", "packed", "cnt", "first_pos", "total").collect()))
    with pytest.raises(ValueError):
        grams.gram_counts(blobs, 0)


_MEMORY = """
import resource, sys
import numpy as np
import pyarrow as pa
from bytelake.operators import grams, stats
size = 160 << 20
b = np.random.default_rng(1).integers(0, 256, 1 << 20, np.uint8)
b = np.resize(b, size)
b[::3] = 7
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for n, part in ((2, b), (3, b), (8, b[: 36 << 20])):
    assert sum(int(c.sum()) for _, c, _ in grams.counted_parts(part, n)) == len(part) - n + 1
assert stats.byte_histogram(b).sum() == size
assert len(stats.window_entropies(b, 256)) == size // 256
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_a_large_blob():
    """160 MB in less than 700 MB beside the blob itself."""
    done = subprocess.run([sys.executable, "-c", _MEMORY], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) < 700


@pytest.mark.parametrize("heavy, n", [(1 << 19, 2), (1 << 19, 9), (40, 2), (1, 9)])
def test_tfidf_by_heavy_hitters(spark, blobs, tmp_path, monkeypatch, heavy, n):
    monkeypatch.setattr(grams, "HEAVY", heavy)
    grams.gram_frequencies(blobs, n).write.parquet(str(tmp_path / "df"))
    df = spark.read.parquet(str(tmp_path / "df"))
    count = Counter(g for raw in BLOBS for g in plain(raw, n))
    assert {(bytes(r.packed) if n > 7 else r.packed.to_bytes(n, "big")): r.df for r in df.collect()} == count and {r.documents for r in df.collect()} == {len(BLOBS)}
    got = sorted((r.blob_id, r["rank"], r.first_pos, round(r.score, 9)) for r in grams.best_tfidf(blobs, df, n, 6).collect())
    want = []
    for i, raw in enumerate(BLOBS):
        own = plain(raw, n)
        top = max((c for c, _ in own.values()), default=1)
        rows = sorted((-round(c / top * (math.log((len(BLOBS) + 1) / (count[g] + 1)) + 1), 12), first) for g, (c, first) in own.items())[:6]
        want += [(str(i), k + 1, first, round(-s, 9)) for k, (s, first) in enumerate(rows)]
    assert got == sorted(want)
    # Frequencies of other blobs: n-grams that they don't hold have df 0.
    grams.gram_frequencies(blobs.where("blob_id = '3'"), n).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    monkeypatch.setattr(grams, "HEAVY", 1 << 19)
    want = sorted(map(str, grams.best_tfidf(blobs, few, n, 6, 50).collect()))
    old = sorted(map(str, grams.select_tfidf(grams.gram_counts(blobs, n), few, 50, 6).join(grams.gram_counts(blobs, n).select("blob_id", "packed", "cnt", "first_pos"), ["blob_id", "packed"]).select("blob_id", "packed", "cnt", "first_pos", "rank", "score").collect()))
    assert want == old


def test_tfidf_shuffles_no_content(spark, blobs, tmp_path):
    grams.gram_frequencies(blobs, 3).write.parquet(str(tmp_path / "df"))
    plan = grams.best_tfidf(blobs, spark.read.parquet(str(tmp_path / "df")), 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def vectors(spark, n, rare=0):
    """Blobs that all have f0; f1 is in a tenth; r<i> are in one or two."""
    rows = [(str(i), "f0", float(i % 7)) for i in range(n)] + [(str(i), "f1", float(i)) for i in range(0, n, 10)]
    rows += [(str(i % n), f"r{i // 2}", float(i)) for i in range(rare)]
    labels = [(str(i), "abc"[i % 7 % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "blob_id string, feature string, value double"), spark.createDataFrame(labels, "blob_id string, label string")


def brute_scores(rows, labels):
    """Full vectors in numpy."""
    blobs, names, classes = sorted(labels), sorted({f for _, f, _ in rows}), sorted(set(labels.values()))
    at = {f: i for i, f in enumerate(names)}
    x, has = np.zeros((len(blobs), len(names))), np.zeros((len(blobs), len(names)), bool)
    place = {b: i for i, b in enumerate(blobs)}
    for b, f, v in rows:
        x[place[b], at[f]], has[place[b], at[f]] = v, True
    low, high = np.where(has, x, np.inf).min(0), np.where(has, x, -np.inf).max(0)
    z = np.where(low == high, np.where(x == low, 0.5, 0.0), (x - low) / np.where(low == high, 1, high - low))
    own = np.array([labels[b] for b in blobs])
    out = {}
    for c in classes:
        pos, neg = (z[m].mean(0) if m.any() else np.zeros(len(names)) for m in (own == c, own != c))
        ratio = (own != c).sum() / (own == c).sum()
        dp, dn = (np.sqrt(((z - m) ** 2).sum(1)) for m in (pos, neg))
        for b, p, q in zip(blobs, dp, dn, strict=True):
            out[b, c] = (q / (p + q) if p + q else 0.5) * (min(3.0, ratio) if ratio > 1 else 1.0)
    return out


@pytest.mark.parametrize("cells", [1 << 20, 12, 1])
def test_scores_with_and_beyond_the_matrix(spark, tmp_path, monkeypatch, cells):
    feats, labels = vectors(spark, 60, 90)
    classifier.train_ensemble(feats, labels).save(str(tmp_path / "m"))
    model = classifier.Model.load(spark, str(tmp_path / "m"))
    monkeypatch.setattr(classifier, "MATRIX_CELLS", cells)
    got = {(r.blob_id, r.label): r.score for r in classifier.class_scores(feats, labels, model).collect()}
    want = brute_scores([tuple(r) for r in feats.collect()], {r.blob_id: r.label for r in labels.collect()})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_scores_of_odd_rows(spark, tmp_path):
    feats, labels = vectors(spark, 40, 20)
    classifier.train_ensemble(feats, labels).save(str(tmp_path / "m"))
    model = classifier.Model.load(spark, str(tmp_path / "m"))
    blobs = spark.createDataFrame([("x",), ("y",), ("z",)], "blob_id string")
    odd = spark.createDataFrame([("x", "f0", None), ("x", "unknown", 1.0), ("y", None, 1.0), ("w", "f0", 1.0)], "blob_id string, feature string, value double")
    got = {(r.blob_id, r.label): r.score for r in classifier.class_scores(odd, blobs, model).collect()}
    assert len(got) == 9 and all(0 <= s <= 3 for s in got.values()) and all(got["y", c] == got["z", c] for c in "abc")
    none = feats.limit(0)
    assert classifier.class_scores(none, blobs.limit(0), model).count() == 0
    empty = classifier.train_ensemble(none, labels.limit(0))
    empty.save(str(tmp_path / "e"))
    assert classifier.class_scores(feats, blobs, classifier.Model.load(spark, str(tmp_path / "e"))).count() == 0


def test_a_feature_that_all_blobs_have(spark, tmp_path, monkeypatch):
    """No exchange by feature alone, on either path, and 100,000 blobs scored."""
    n = 100_000
    base = spark.range(n, numPartitions=8).select(F.col("id").cast("string").alias("blob_id"), "id")
    feats = base.select("blob_id", F.lit("f0").alias("feature"), (F.col("id") % 7).cast("double").alias("value"))
    feats = feats.unionByName(base.select("blob_id", F.concat(F.lit("r"), F.col("id") % 500).alias("feature"), F.lit(1.0).alias("value")))
    labels = base.select("blob_id", F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("label"))
    classifier.train_ensemble(feats, labels).save(str(tmp_path / "m"))
    model = classifier.Model.load(spark, str(tmp_path / "m"))
    scores = []
    for cells in (1 << 20, 20):
        monkeypatch.setattr(classifier, "MATRIX_CELLS", cells)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        scored = classifier.class_scores(feats, labels, model)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        keyed = re.findall(r"Exchange hashpartitioning\(feature#\d+, \d+\)", plan)
        assert len(keyed) <= 2 * plan.count("parquet")  # the model's own tables, by feature
        assert (("_salt" in plan) == (cells == 20)) and ("hashpartitioning(feature#" not in plan.split("MapInArrow")[-1] or cells == 20)
        scores.append(scored.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("s")).orderBy("label").collect())
    assert scores[0] == scores[1] and [r.n for r in scores[0]] == [n, n]


def test_last_value_of_a_name_without_a_shuffle(spark, blobs):
    pipeline = features.FeaturePipeline([features.ngram_extractor(2, 4), stats.length_features, stats.entropy_features, features.ngram_extractor(3, 4)])
    rows = pipeline.extract(blobs, last=True)
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    show = lambda df: sorted(map(str, df.select("blob_id", "feature", "value").collect()))
    assert show(rows) == show(features.resolve_features(pipeline.extract(blobs)))
    # An array of a name that the helper emits too, before and after it.
    clash = lambda blobs, name: blobs.withColumn(name, F.array(F.struct(F.lit(0).alias("emit_idx"), F.lit("global_entropy").alias("feature"), F.lit(-2.0).alias("value"))))
    loud = lambda blobs: clash(blobs, "r").select("blob_id", F.inline("r"))
    loud.array = clash
    for both in (pipeline.add(loud), features.FeaturePipeline([loud, *pipeline.extractors]), features.FeaturePipeline([loud, loud])):
        rows = both.extract(blobs, last=True)
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        assert show(rows) == show(features.resolve_features(both.extract(blobs)))
    own = pipeline.add(lambda b: b.select("blob_id", F.lit(0).alias("emit_idx"), F.lit("global_entropy").alias("feature"), F.lit(-1.0).alias("value")))
    assert show(own.extract(blobs, last=True)) == show(features.resolve_features(own.extract(blobs)))


def test_markov_lines(spark, blobs, tmp_path):
    stats.save_markov(stats.corpus_markov(blobs), str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert len(lines) == 258 and all(line.count(",") == 255 for line in lines)
    assert sum(map(int, lines[0].split(","))) == sum(map(int, lines[-1].split(","))) == sum(map(bool, BLOBS))


class Tapped:
    """Stands for a table whose helper is run here, on batches at hand."""

    columns = ("blob_id", "content")

    def select(self, *_):
        return self

    def mapInArrow(self, helper, _):
        return helper


def test_instructions_of_a_batch_of_many_blobs_are_sent_back_in_parts():
    raw = [RNG.integers(0, 256, 600, np.uint8).tobytes() for _ in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(raw))]), pa.array(raw)], ["blob_id", "content"])
    helper, seen = machine.instruction_table(Tapped()), Counter()
    tracemalloc.start()
    for out in helper(iter([batch])):
        seen.update(out.column(0).to_pylist()[:: out.num_rows - 1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {"0", "2999"} <= set(seen) and peak < 60e6
    alone = [r for b in raw[:3] for r in zip(*(machine.sweep(b, machine.sizes_table(), np.empty(0, np.int64))[c].tolist() for c in ("offset", "addr", "len")), strict=True)]
    first = next(helper(iter([batch.slice(0, 3)])))
    assert list(zip(*(first.column(c).to_pylist() for c in ("offset", "addr", "len")), strict=True)) == alone


@pytest.mark.parametrize("name", ["full", "ngram"])
def test_presets_with_a_histogram_need_no_shuffle(blobs, name):
    rows = features.preset(name).extract(blobs, last=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.replace("REPARTITION_BY_NUM", "") and "Aggregate" not in plan
    got = {(r.blob_id, r.feature): (r.extractor_idx, r.emit_idx, r.value) for r in rows.collect()}
    want = features.resolved(features.preset(name).extract(blobs)).collect()
    assert len(want) == len(got) == rows.count()
    for r in want:
        x, e, value = got[r.blob_id, r.feature]
        assert (x, e) == (r.extractor_idx, r.emit_idx) and (value == r.value or math.isnan(value) and math.isnan(r.value))


def test_names_of_a_histogram_that_others_emit_too(blobs):
    own = lambda b: (["b_7"], [-1.0])
    other = features.ngram_extractor(1, 1)
    other.values, other.prefixes = own, ("b_",)
    for order, want in (([stats.histogram, other], {-1.0}), ([other, stats.histogram], None)):
        rows = features.FeaturePipeline(order).extract(blobs, last=True)
        values = [r.value for r in rows.where("feature = 'b_7'").collect()]
        assert len(values) == len(BLOBS) and rows.count() == 256 * len(BLOBS) and (set(values) == want if want else -1.0 not in values)


def test_the_first_of_equal_values():
    for k in (0, 1, 3, 50, 400, 500):
        value, first = RNG.integers(0, 9, 400).astype(float), RNG.permutation(400)
        assert grams._first_of(value, first, k).tolist() == np.lexsort((first, -value))[:k].tolist()


def test_ngrams_of_one_length_are_counted_once(monkeypatch):
    """Two extractors of a preset that follow one another take the same n-grams."""
    from bytelake.operators import features, grams

    lengths, counted = [], grams.counted_parts
    monkeypatch.setattr(grams, "counted_parts", lambda b, n: lengths.append(n) or counted(b, n))
    blob = np.frombuffer(b"some bytes of a blob, some bytes of it twice", np.uint8)
    found = [f.values(blob) for f in features.preset("streamlined").extractors if hasattr(f, "values")]
    assert lengths == [1, 2, 3, 4] and all(names for names, _ in found)


def test_picked_ngrams_are_sent_back_some_at_a_time():
    """The rows of a batch of blobs don't wait for its last blob."""
    import pyarrow as pa

    from bytelake.operators import grams

    class Blobs:
        def select(self, *_):
            return self

        def mapInArrow(self, go, _):
            return go

    go = grams._picked(Blobs(), 16, lambda b: grams.best_of(b, 16, 16, "frequency")[0], [])
    texts = [f"{i:05}" * 10 + "a text of some length" * (i % 3) for i in range(3000)]
    rb = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3000)]), pa.array([t.encode() for t in texts], pa.binary())], ["blob_id", "content"])
    sent = list(go(iter([rb])))
    assert max(x.num_rows for x in sent) < grams.PICKED_ROWS + 16 and len(sent) > 1
    rows = [r for x in sent for r in x.to_pylist()]
    for i in (0, 1, 1499, 2999):
        own = [r for r in rows if r["blob_id"] == str(i)]
        (_, c, first), *_ = grams.best_of(np.frombuffer(texts[i].encode(), np.uint8), 16, 16, "frequency")
        assert [(r["cnt"], r["first_pos"], r["rank"]) for r in own] == list(zip(c.tolist(), first.tolist(), range(1, len(c) + 1), strict=True))
        assert all(r["packed"] == texts[i].encode()[r["first_pos"] : r["first_pos"] + 16] for r in own)
