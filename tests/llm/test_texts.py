"""Operators on single texts, against brute force, round trips and held-out labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.llm import common, decontaminate, language_id, language_model, packing, quality, sharding, substring_dedup, url_filter
from tests.llm.conftest import prose


def test_packing_round_trip(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.tokenizer_path()
    tk = tokenizers.Tokenizer.from_file(path)
    got = packing.pack_documents(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert max(sequences) == len(sequences) - 1
    for k, t, *_ in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = pieces[k]
        assert sum(p.length for p in own) == len(ids) * sum(r[0] == k for r in rows)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "x <|endoftext|> y", "<|endoftext|>", " <|endoftext|><|endoftext|>a", "<|endoftext |> <|endoftext|", "don't  it's", "é ü z", "a  b", "\t", "1 2,3", "é 日本 語", "a \x1c b"])
def test_pieces_of_text_give_the_tokenizers_ids(text):
    tokenizers = pytest.importorskip("tokenizers")
    tk = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    ids = packing.Ids(*packing.load_encoder(packing.tokenizer_path()))
    assert np.frombuffer(ids.of(text), "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids


def test_random_texts_give_the_tokenizers_ids():
    tokenizers = pytest.importorskip("tokenizers")
    tk = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    ids = packing.Ids(*packing.load_encoder(packing.tokenizer_path()))
    rng = np.random.default_rng(12)
    parts = [" ", "  ", "\n", "\t", "a", "Don't", "é", "日本", "12", "3.5", "!?", "<|endoftext|>", "\u00a0", "\u0301", "<|", "|>", "'ll", "\r\n", "😀"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids, text


def test_plan_uses_every_length():
    rng = np.random.default_rng(2)
    for hist in ({2047: 5}, {1: 10_000}, {1024: 7, 1000: 9, 24: 3}, dict(Counter(rng.integers(1, 2048, 20_000).tolist())), {}):
        used, windows = Counter(), 0
        for c, times in packing.plan(hist):
            assert sum(n * k for n, k in c.items()) <= 2048
            windows += times
            for n, k in c.items():
                used[n] += k * times
        assert used == Counter(hist)
    assert windows == 0
    hist = dict(Counter(rng.integers(1, 2048, 20_000).tolist()))
    total = sum(n * k for n, k in hist.items())
    assert total / 2048 / sum(t for _, t in packing.plan(hist)) > 0.97


def test_sharding(docs, rows, none, spark):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert len(got) == len(rows)
    size = {r[0]: len((r[1] or "").encode()) + 16 for r in rows}
    total, slots = Counter(), defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], zlib.crc32((dict((x[0], x[1]) for x in rows)[r.doc_id] or "").encode()), "bytes", None)
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 2 * max(size.values())
    assert sharding.shard_documents(none).count() == 0
    same = spark.range(9000).selectExpr("id AS doc_id", "'same' AS text")  # one group of copies is subdivided
    assert sorted(r["count"] for r in sharding.shard_documents(same).groupBy("shard").count().collect()) == [225] * 40


def test_lm_scores(docs, rows, none):
    got = {r.doc_id: r for r in language_model.score_texts(docs).collect()}
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    seen = Counter(w for k, ws in tokens if not out(k) for w in ws)
    n, v = sum(seen.values()), len(seen)
    for k, ws in tokens:
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(k), len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    assert language_model.score_texts(none).count() == 0


def test_lm_is_normalised():
    """Probabilities of all symbols add up to 1 after any context, before and after training."""
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(1, 500, 70))[::-1].astype(float)
    model = language_model.Model(counts)
    seen = [np.full(p.shape, 1e-6, np.float32) for p in model.params]
    for steps in range(2):
        for context in rng.integers(0, 70, (5, 2)):
            p = np.exp(model.log_probabilities(np.arange(70), np.repeat(context[:, None], 70, 1)))
            assert p.sum() == pytest.approx(1, abs=1e-5)
            assert steps or np.allclose(p, (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-3)
        for _ in range(50):
            model.train(rng.integers(0, 70, 500), rng.integers(0, 70, (2, 500)), seen, rng)


def test_lm_contexts():
    got = language_model.contexts(np.array([1, 2, 3, 9, 4, 9, 9]), np.array([0, 4, 6]), 9)
    assert got.tolist() == [[9, 1, 2, 3, 9, 4, 9], [9, 9, 1, 2, 9, 9, 9]]


def test_lm_learns_order(spark):
    """Held-out text with the same order scores better than its base by far, the words in another order worse."""
    import random

    rng = random.Random(2)
    names = [f"w{i}" for i in range(40)]
    then = {x: rng.sample(names, 2) for x in names}

    def text():
        w = [rng.choice(names)]
        while len(w) < 300:
            w.append(rng.choice(then[w[-1]]))
        return w

    rows = [(i, " ".join(text())) for i in range(300)]
    mixed = [" ".join(sorted(t.split(), key=lambda _: rng.random())) for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in language_model.score_texts(df).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    out = df.unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(mixed, 10_000) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string"))
    got = {r.doc_id: r for r in language_model.score_texts(out).collect()}
    assert all(r.score < r.base_score for k, r in got.items() if k >= 10_000)


def test_lm_tells_rarer_words_apart():
    """Words beyond the 1,022 most frequent ones have symbols and an order of their own; words that aren't told apart have
    that of their class."""
    rng = np.random.default_rng(6)
    hashes = rng.integers(1, 1 << 64, 2000, np.uint64)
    counts = np.concatenate([np.sort(rng.integers(64, 500, 1500))[::-1], np.full(500, 5)])
    index = language_model.Index(hashes, counts)
    symbols, held = index(np.append(hashes, [np.uint64(0), np.uint64(12345)]))
    assert symbols[:1500].tolist() == list(range(1500)) and held[:2000].tolist() == counts.tolist() and held[-1] == -1
    assert len(set(symbols[1500:2000].tolist())) > 50 and ((symbols[1500:2000] >= 1500) & (symbols[1500:2000] < index.stop)).all()
    assert symbols[-2] == index.stop and symbols[-1] == 1500
    sizes = np.append(counts[:1500], np.full(index.stop - 1499, 40)).astype(float)
    model, cycle = language_model.Model(sizes), np.tile(np.arange(1470, 1500), 100)
    seen = [np.full(p.shape, 1e-6, np.float32) for p in model.params]
    context = language_model.contexts(cycle, np.array([0]), index.stop)
    before = model.log_probabilities(cycle, context)[2:]
    for _ in range(60):
        model.train(cycle, context, seen, rng)
    after = model.log_probabilities(cycle, context)[2:]
    other = model.log_probabilities(rng.permutation(cycle), context)[2:]
    assert after.mean() > before.mean() / 2 and after.mean() > other.mean() + 2


def test_lm_copies_grow_with_tokens_not_partitions(spark, monkeypatch):
    sent, real = [], common.run_groups

    def spy(df, *rest):
        sent.append(df)
        return real(df, *rest)

    monkeypatch.setattr(common, "run_groups", spy)
    texts = [(i, " ".join(f"w{(i * j) % 50}" for j in range(400))) for i in range(64)]
    out = language_model.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(16)).collect()
    tokens = sum(401 for i, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2)
    copies = [np.frombuffer(r.n, np.int64) for r in sent[0].where("part = 1").collect()]  # a row a copy
    assert 1 < len(copies) <= tokens / (64 * 65) < 8  # 64 classes and the end at least are outputs
    assert sum(n[0] for n in copies) == tokens and len(out) == 64


def test_tokens_are_the_words_of_split_words():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    parts = ["a", "A", "b", " ", "\t", "\n", "\x0b", "\x1c", "\u00a0", "é", "É", "日本", "x" * 64, "x" * 65, "X" * 70, ""]
    texts = [None, "", " ", "a", *("".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(2000)), None]
    seen = {}
    for array, own in ((pa.array(texts), texts), (pa.array(texts).slice(3, 500), texts[3:503]), (pa.array(["", None]), ["", None]), (pa.array([], pa.string()), [])):
        h, starts = language_model.hash_tokens(array)
        words = [[*common.split_words(t), None] for t in own]
        assert starts.tolist() == np.cumsum([0, *map(len, words)])[:-1].tolist()
        flat = [w for ws in words for w in ws]
        assert len(h) == len(flat)
        for w, x in zip(flat, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) and seen[None] == language_model.END


def test_quality(spark):
    import random

    rng = random.Random(3)
    texts = [(i, prose(rng, "en", 120) if i % 2 else " | ".join(prose(rng, "fr", 60).upper().split()), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in texts] + [(900, None, "x"), (901, "", "x"), (None, "a b", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in texts] + [(None, 1, 0), (902, None, 0), (903, 5, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i, *_ in texts if got[i].held_out]
    assert held and held == [i for i, *_ in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i].score >= 0.5) == (i % 2 == 1) for i in held) >= 0.95 * len(held)
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    assert quality.score_quality(docs, labels.where("false")).count() == 403


def test_quality_is_calibrated_on_whole_texts(spark):
    """The logistic's inputs are the differences of whole texts, computed here one by one."""
    import random

    rng = random.Random(4)
    texts = [(i, prose(rng, "en" if i % 2 else "fr", 2500), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int")
    good, bad, (mean, scale, w) = quality.fit(docs, labels)
    half = [r.doc_id for r in labels.where(~quality.held_out("doc_id", 4)).where("pmod(xxhash64(doc_id, 'fit'), 2) = 1").collect()]
    x = np.array([quality.Difference(good, bad)(texts[i][1]) for i in half])
    assert mean[0] == pytest.approx(x.mean()) and scale[0] == pytest.approx(x.std(), rel=1e-6)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert all(got[i] == pytest.approx(1 / (1 + math.exp(-((d - mean[0]) / scale[0] * w[1] + w[0])))) for i, d in zip(half, x, strict=True))


def test_quality_of_long_and_repeated_rows(spark):
    rows = [(i, ("good words here " if i % 2 else "BAD | STUFF ! ") * 30, i % 2) for i in range(80)] + [(200, "good words here " * 20_000, 1), (1, "good words here " * 30, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = quality.score_quality(docs, spark.createDataFrame([(i, q) for i, _, q in rows[:80]], "doc_id long, quality int")).collect()
    assert len(got) == 82 and len({r.score for r in got if r.doc_id == 1}) == 1 and all((r.score > 0.5) == (r.doc_id % 2 == 1 or r.doc_id == 200) for r in got)


def test_language_id(spark, docs, rows, none):
    html = [(r[0], f"https://{'a' if r[2] == 'en' else 'b'}.site.org/x", f"<html><script>le de</script><body>{r[1]}</body></html>") for r in rows[:60]]
    html += [(100, "https://a.site.org/", None), (101, None, None), (102, "https://b.site.org", '<html lang="fr"></html>'), (103, "nonsense", "<p>the of and</p>")]
    pages = spark.createDataFrame([(*h, "de") for h in html], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language_id.identify_pages(pages, docs).collect()}
    assert len(got) == len(html)
    long = [r for r in rows[:60] if len(r[1]) > 60]
    assert sum(got[r[0]].lang == r[2] for r in long) >= 0.97 * len(long)
    assert got[101].lang == "und" and got[101].confidence == 0 and got[102].lang == "fr"
    assert language_id.identify_pages(pages.where("false"), docs).count() == 0
    assert {r.lang for r in language_id.identify_pages(pages, none).collect()} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and 85 in {r.doc_id for r in kept.collect()}


def test_leaks(spark, none):
    items = [(1, "Tom walked 12 miles to the old market in Paris and bought 3 fresh apples for his sister"), (2, "alpha beta gamma"), (3, None), (None, "x y z")]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, h string")
    other = "Ann walked 70 miles to the old market in Rome and bought 9 fresh apples for his sister"
    mixed = "Tom walked 12 miles to the old market in Tom and bought 3 fresh apples for his sister"
    texts = [(10, f"So it was. {items[0][1]} and more"), (11, f"and {other} then"), (12, mixed.replace("sister", "brother")), (13, "say alpha  beta, gamma!"), (14, None), (15, ""), (None, items[0][1]), (16, "Tom walked 12 miles to a new place")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, item long")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate.judge_documents(docs, bench).collect()}
    assert got[10] == got[11] == (True, [1]) and got[13] == (True, [2])
    assert not any(got[k][0] for k in (12, 14, 15, None, 16))
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {12, 14, 15, None, 16}
    assert decontaminate.judge_documents(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.judge_documents(docs, bench.where("false")).collect())


def test_leaks_by_readings_names_and_figures(spark):
    q = "Tom has 12 red apples and his friend gives some more to him before the long walk to Paris with his old dog"
    items = [(1, q), (1, "what is the sum of all prime numbers below twenty"), (2, "12 + 34 = 46"), (3, "Anna bought 5 kg of the best flour in New York")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = q.replace("Paris", "New York").replace("Tom", "Mary Jane Watson").replace("12", "9")
    broken = q.replace("his friend", "his very good friend")
    clash = "Ann has 12 red apples and his friend gives some filler more to him before the long walk to Ann with his old dog"
    texts = [(10, names), (11, broken), (12, clash), (13, "it was 12 + 34 = 46"), (14, "1 2 3 4 5 6 " * 20), (15, "say: what is the sum of all prime numbers below twenty?"), (16, "Question Anna bought 5 kg of the best flour in Rome"), (17, f"{q} " * 400), (18, q), (18, "nothing here"), (18, q)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, x long")
    got = {(r.doc_id): r for r in decontaminate.judge_documents(docs, bench).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {10, 11, 13, 15, 16, 17, 18}
    assert got[15].item_ids == got[10].item_ids == [1] and got[13].item_ids == [2] and got[16].item_ids == [3]
    share = {(r.doc_id, r.item_id): r.share for r in decontaminate.find_leaks(docs, bench).collect()}
    assert share[10, 1] == share[18, 1] == 1 and 0.5 <= share[11, 1] < 1


def test_long_runs_of_names_and_figures(spark):
    """A name of 20,000 words and a number of 20,000 parts are a token each, without a deep stack."""
    item = "how many red apples are left when the old man takes some of them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, "Stea " * 20000 + item), (2, "1.2," * 20000 + item), (3, "Stea " * 20000), (4, "Ünder\t\n" * 20000 + "1,5 kg")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = docs.select("doc_id", F.size(decontaminate.tokens(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 15, 2: 15, 3: 1, 4: 3}
    assert {r.doc_id for r in decontaminate.judge_documents(docs, bench).collect() if r.contaminated} == {1, 2}


def test_repeats(docs, rows, none):
    got = {r.doc_id: r for r in substring_dedup.judge_documents(docs).collect()}
    assert not got[75].repeats and all(got[i].repeats and 30 <= got[i].removed_words <= 80 for i in range(76, 80))
    assert all(got[i].repeats for i in range(70, 75) if len(rows[7][1].split()) > 30)
    assert not any(got[i].repeats for i in range(60) if i != 7)
    assert not any(got[i].repeats for i in (80, 81, 82, 83, 84, 85, None))
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for i in range(76, 80):
        w, kept = rows[i][1].split(), out[i].text.split()
        cut = {j for s in got[i].spans for j in range(s.a, s.b)}
        assert kept == [x for j, x in enumerate(w) if j not in cut] and out[i].n_chars == len(out[i].text)
    assert out[3].text == rows[3][1] and substring_dedup.remove_repeats(none).count() == 0


def test_near_paragraphs_equal_brute_force(spark):
    """Clusters of the lines of real documents with near variants, against all pairs."""
    rng = np.random.default_rng(9)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text]
    own = [x for t in texts for x in t.split("\n") if len(x.split()) >= substring_dedup.LEAST]
    for x in own[:150]:
        w = x.split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = f"v{rng.integers(0, 10**6)}"
        own.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.lower().split() for x in own)]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.judge_documents(df).collect()}
    later = {max(p) for p in near}
    whole = {i for i in got if got[i].removed_words == len(own[i].split())}
    assert len(later) > 60 and len(later & whole) >= 0.98 * len(later)
    comp = list(range(len(own)))
    for a, b in sorted(near, key=min):
        x, y = comp[a], comp[b]
        comp = [min(x, y) if c in (x, y) else c for c in comp]
    grams = [Counter(zip(*(x.lower().split()[k:] for k in range(5)), strict=False)) for x in own]
    total = sum(grams, Counter())
    for i in (i for i in got if got[i].repeats and comp[i] == i):  # not a near paragraph: repeated pieces, found elsewhere
        w = own[i].lower().split()
        for x in got[i].spans:
            runs = [tuple(w[j : j + 5]) for j in range(x.a, x.b - 4)]
            assert sum(total[g] > 1 for g in runs) >= 0.6 * len(runs)


def test_only_documents_with_spans_are_moved(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(str(rng.random()) for _ in range(40))) for i in range(400)]
    texts += [(400, texts[7][1] + " tail"), (None, texts[7][1])]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))
        got = {r.doc_id: r.text for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)

    def written(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan") or "QueryStage" in plan.nodeName():
            return written(plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.plan())
        own = [plan.metrics().get("shuffleRecordsWritten").get().value()] if plan.nodeName() == "Exchange" else []
        return own + [n for i in range(plan.children().size()) for n in written(plan.children().apply(i))]

    moved = written(df._jdf.queryExecution().executedPlan())
    assert moved and max(moved) < 10
    assert len(got) == 402 and got[400] == "" and all(got[k] == t for k, t in texts if k != 400)


def test_split_by_bitmap(spark):
    df = spark.range(-500, 500).selectExpr("IF(id = 9, null, id) AS k", "id AS bit_word")
    near, rest = common.split_by_bitmap(df, "k", spark.createDataFrame([(-129,), (63,), (400,), (None,)], "k long"), 1 << 10)
    assert {r.k for r in near.collect()} == {-129, 63, 400} and near.columns == rest.columns == ["k", "bit_word"]
    assert {r.k for r in rest.collect()} == {*range(-500, 500), None} - {-129, 63, 400, 9}


def test_repeats_of_one_id_with_two_texts(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    df = spark.createDataFrame([(1, line), (2, line), (2, "short"), (3, line + "\nrest"), (3, line + "\nrest"), (4, None)], "doc_id long, text string")
    out = substring_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == [(1, line), (2, line), (2, "short"), (3, "rest"), (3, "rest"), (4, "")]


def buckets(spark, sets, keys):
    """members and sets of near_paragraphs, from sets {p: shingles} and keys {key: paragraphs}."""
    members = spark.createDataFrame([(key, p, len(ps)) for key, ps in keys.items() for p in ps], "key long, p long, c long")
    rows = [(p, len(w), bytearray(np.array(sorted(w), np.uint64).tobytes())) for p, w in sets.items()]
    return members, spark.createDataFrame(rows, "k long, n long, own_set binary")


def joined(edges):
    """Components of edges (a, b) as sets of two or more."""
    return {frozenset(r.ids) for r in common.components(edges).groupBy("component").agg(F.collect_set("id").alias("ids")).collect()}


@pytest.mark.parametrize("others", [3, 30])
def test_unlike_head_hides_no_pair(spark, others):
    """Two near paragraphs in a bucket whose least paragraph is like neither; a small bucket and a large one."""
    near = {100: range(1000, 1020), 101: range(1001, 1021)}
    unlike = {p: range(5000 + 50 * p, 5020 + 50 * p) for p in range(others)}
    sets = near | unlike
    assert min(sets) == 0 and (len(sets) > substring_dedup.PAIRED) == (others == 30)
    assert joined(substring_dedup.near_paragraphs(*buckets(spark, sets, {7: list(sets)}))) == {frozenset([100, 101])}


def test_buckets_equal_brute_force(spark):
    """Buckets of all sizes that overlap, of near and unlike sets: edges join nothing but what near pairs join, and all near pairs of a bucket."""
    rng = np.random.default_rng(12)
    sets = {}
    for p in range(240):
        start = 1000 * int(rng.integers(0, 12))
        sets[p] = set(range(start, start + 30)) - set(rng.integers(start, start + 30, 3).tolist()) | set(rng.integers(10**6, 10**9, int(rng.integers(0, 5))).tolist())
    keys = {k: sorted(set(rng.integers(0, 240, n).tolist())) for k, n in enumerate((2, 3, 5, 9, 16, 17, 40, 60, 120))}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    comp = list(range(240))
    for a, b in ((a, b) for a in sets for b in range(a) if near(a, b)):
        comp = [comp[b] if c == comp[a] else c for c in comp]
    edges = substring_dedup.near_paragraphs(*buckets(spark, sets, keys))
    assert all(comp[r.a] == comp[r.b] for r in edges.collect())
    of = {p: x for x in joined(edges) for p in x}
    links = {(a, b) for ps in keys.values() for a in ps for b in ps if a < b and near(a, b)}
    assert len(links) > 50 and all(b in of.get(a, ()) for a, b in links)


def test_common_line_with_variants_lists_few_pairs(spark):
    """3,000 variants of one line in one bucket are one component by a few comparisons each, not by all pairs."""
    rng = np.random.default_rng(13)
    sets = {p: set(range(60)) - {int(rng.integers(0, 60))} | {10**6 + p} for p in range(3000)}
    edges = substring_dedup.near_paragraphs(*buckets(spark, sets, {1: list(sets)}))
    assert edges.count() < 12 * len(sets) and joined(edges) == {frozenset(sets)}


def test_paragraphs_stand_anywhere():
    rng = np.random.default_rng(4)
    for _ in range(200):
        passage = rng.integers(0, 2**63, 55).astype(np.uint64)
        cuts = []
        for _ in range(2):
            ahead = rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)
            at = substring_dedup.pieces(np.concatenate([ahead, passage, ahead[:9]])) - len(ahead)
            cuts.append(set(at[(at >= 6) & (at < 49)].tolist()))
        assert cuts[0] == cuts[1]


def test_urls(spark):
    urls = [
        ("https://shop.NET/x", "shop.net", "/x", "net/", "block"),
        ("http://a.example.net/en/1?q", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        ("x.org/fr/", "", "", None, "allow"),
        ("http://y.org/fr/#a", "y.org", "/fr/", "org/fr/", "allow"),
        ("http://www.some.example.org/en/1/?utm_source=a#b", "www.some.example.org", "/en/1/", None, "block"),
        ("https://some.example.org/en/1.html", "some.example.org", "/en/1.html", None, "block"),
        ("https://some.example.org/en/2", "some.example.org", "/en/2", None, "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://long.example.org/" + "a" * 50_000, "long.example.org", "/" + "a" * 50_000, None, "allow"),
    ]
    html = {6: "<p>What an IDIOT.</p>", 8: "<p>idiotic</p>", 9: None, 10: "worthless"}
    df = spark.createDataFrame([(i, u[0], "h", html.get(i, "fine"), "x") for i, u in enumerate(urls)] + [(6, urls[6][0], "h", None, "x")], "page_id long, url string, host string, html string, canonical string")
    got = url_filter.judge_urls(df, url_filter.listed_urls(df)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == tuple("" if x is None and i < 2 else x for i, x in enumerate(urls[r.page_id][1:])), r.page_id
    assert url_filter.judge_urls(df.where("false"), url_filter.listed_urls(df)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, url_filter.listed_urls(df.where("false"))).collect()} == {"block", "allow"}


def test_bloom_passes_every_listed_url(spark):
    listed = spark.range(3000).selectExpr("concat('h/', id) AS canonical")
    asked = spark.range(2000, 6000).selectExpr("concat('h/', id) AS canonical", "id AS _x")
    got = url_filter.block_listed(asked, listed)
    assert got.where("listed").count() == 1000 and got.count() == 4000 and got.columns == ["canonical", "_x", "listed"]
