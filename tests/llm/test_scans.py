"""License scan, ranked search and periodic runs, against brute force in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.llm import lexical_search, license_scan, periodic_runs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTICES = {
    100: "A first line.\nReleased under the MIT License.",
    101: "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0\nmit license, MIT-License mit License",
    102: "This work is licensed under the GNU General Public License, version 3.",
    103: "Übung É mit é license\nversion 2 of the license apache, the licensed under 0",  # words of a notice in another order
    104: "Released under the License that is not there",
    105: " ".join(f"w{i}" for i in range(50)) + " Licensed under CC BY-NC 4.0 " + " ".join(f"w{i}" for i in range(300)),  # in the middle of a long line
    106: "Redistribution and use in source or binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def tokens(text):
    return re.findall(license_scan._WORD, (text or "").translate(LOW))


def licenses(text):
    ws = tokens(text)
    spots = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    found = {}
    for line in (text or "").split("\n"):
        w = tokens(line)
        for i in range(0, max(len(w) - 32, 1), 32):
            for label, notice in license_scan.TEMPLATES:
                t = set(tokens(notice))
                if 100 * len(t & set(w[i : i + 64])) >= 90 * len(t):
                    found[label] = max(found.get(label, 0), len(t & set(w[i : i + 64])) / len(t))
    base = {label for _, label in spots}
    at = [i for i, _ in spots]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), 1.0 if at else max(found.values(), default=0.0)


def test_license_scan(spark, docs, rows, none):
    more = spark.createDataFrame([(k, t, "en", "s", len(t), 1, "x", None, 1) for k, t in NOTICES.items()], docs.schema)
    both = docs.unionByName(more).unionByName(more.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = license_scan.scan_licenses(both.withColumn("low", F.lit(1)).withColumn("words", F.lit("y")).withColumn("x", F.lit(2))).drop("shares").collect()
    texts = {r[0]: r[1] for r in rows if r[0] is not None} | NOTICES
    assert len(got) == len(rows) + len(NOTICES) + 1
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == licenses(texts[r.doc_id]), r
    of = {r.doc_id: r.labels for r in got}
    assert of[100] == "mit" and of[101] == "apache,mit" and of[105] == "cc-by-nc" and of[106] == "bsd" and of[104] == ""
    assert license_scan.scan_licenses(none).count() == 0
    # Two notices of one id are judged apart.
    twice = more.where("doc_id IN (100, 102)").withColumn("doc_id", F.lit(7).cast("long"))
    assert sorted(r.labels for r in license_scan.scan_licenses(twice).collect()) == ["gpl", "mit"]


def test_license_templates_of_a_table(spark):
    long = " ".join(f"t{i}" for i in range(70))  # three pieces
    docs = spark.createDataFrame([(1, long), (2, " ".join(f"t{i}" for i in range(40))), (3, "x y"), (4, None)], "doc_id long, text string")
    own = spark.createDataFrame([("long", long), ("none", None), (None, "x y"), ("xy", "Y x"), ("xy", "Y x")], "label string, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs, own).collect()}
    assert got == {1: ("long", 1.0), 2: ("", 0.0), 3: ("xy", 1.0), 4: ("", 0.0)}
    assert {r.labels for r in license_scan.scan_licenses(docs, own.limit(0)).collect()} == {""}


@pytest.mark.parametrize("words", [0, 1 << 17])
def test_license_templates_beyond_the_broadcast_bound(spark, docs, monkeypatch, words):
    monkeypatch.setattr(license_scan, "BROADCAST_WORDS", words)
    more = spark.createDataFrame([(k, t) for k, t in NOTICES.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan_licenses(more).collect()} == {k: licenses(t)[5] for k, t in NOTICES.items()}


def ranked(docs, items, top=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(k, Counter(cut(t))) for k, t in docs]
    held = [(k, c) for k, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, q in sorted(items.items()):
        scores = []
        for k, c in held:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in cut(q))
            if score > 0 and k is not None:
                scores.append((-score, k))
        out += [(item, i + 1, k, -s) for i, (s, k) in enumerate(sorted(scores)[:top])]
    return out


ITEMS = {1: "the of one two", 2: "The, THE être", 3: "nowhere at all 12", 4: "", 5: None, 6: "w1 don't"}


@pytest.mark.parametrize("block, cells", [(4 << 20, 1 << 21), (16, 300)])
def test_ranked_search(spark, docs, rows, none, monkeypatch, block, cells):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    items = spark.createDataFrame([*ITEMS.items(), (1, ITEMS[1]), (None, "the")], "item_id long, text string").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in lexical_search.rank_documents(docs.withColumn("terms", F.lit(1)), items).collect())
    want = ranked([(r[0], r[1]) for r in rows], ITEMS)
    assert got == want and len(want) > 40
    assert lexical_search.rank_documents(none, items).count() == 0
    assert lexical_search.rank_documents(docs, items.limit(0)).count() == 0
    empty = docs.where("text IS NULL OR text = ''")
    assert lexical_search.rank_documents(empty, items).count() == 0


def test_ranks_of_equal_scores(spark):
    docs = spark.createDataFrame([(100 - i, "same words here") for i in range(60)] + [(200, "other"), (201, "others, others")], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "same same"), (1, "other")], "item_id long, text string")  # one item of two texts
    got = [tuple(r) for r in lexical_search.rank_documents(docs, items).orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 200), *((i, 39 + i) for i in range(2, 21))]


def runs_of(words):
    """All runs by comparing words at every distance."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        a = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i + q - a >= max(6, 4 * q):
                    out.setdefault((a, i + q), q)
                a = i + 1
    return sorted((a, z - a, q) for (a, z), q in out.items())


def test_find_runs():
    rng = np.random.default_rng(4)
    for _ in range(250):
        texts = []
        for _ in range(rng.integers(0, 6)):
            n, kinds = int(rng.integers(0, 150)), int(rng.integers(1, 6))
            t = rng.integers(0, kinds, n)
            if n and rng.random() < 0.6:
                a = int(rng.integers(0, n))
                p = int(rng.integers(1, max(2, (n - a) // 3 + 1)))
                t = t[[a + (i - a) % p if i >= a else i for i in range(n)]]
            texts.append(t)
        assert periodic_runs.find_runs(texts) == [runs_of(t.tolist()) for t in texts]


def test_long_periods_and_long_runs():
    rng = np.random.default_rng(5)
    t = rng.integers(0, 3000, 20_000)
    assert periodic_runs.find_runs([t, t[7 + (np.arange(20_000) - 7) % 4111], np.zeros(20_000, np.int64)]) == [[], [(0, 20_000, 4111)], [(0, 20_000, 1)]]
    assert periodic_runs.find_runs([np.arange(200_000) % 40_000]) == [[(0, 200_000, 40_000)]]


def test_transform_and_its_inverse():
    rng = np.random.default_rng(6)
    for n in (1, 2, 8, 64):
        a, b = rng.integers(0, periodic_runs.PRIME, (2, 3, n)).astype(np.uint64)
        got = periodic_runs.ntt(periodic_runs.ntt(a) * periodic_runs.ntt(b) % np.uint64(periodic_runs.PRIME), inverse=True)
        want = [[sum(int(x[i]) * int(y[(k - i) % n]) for i in range(n)) * n % periodic_runs.PRIME for k in range(n)] for x, y in zip(a, b, strict=True)]
        assert got.tolist() == want


def digest(k, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(k).encode())
    g = h // 10
    if k is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = runs_of(w)
    drop = {i for a, m, q in runs for i in range(a + q, a + m)}
    a, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()
    return k, len(runs), a, m, q, m and 1000 * m // q, sha(listed), sha(b" ".join(w[i] for i in range(n) if i not in drop))


def test_periodic_runs(spark, docs, rows, none):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, rng.integers(1, 30), rng.integers(0, 200))) for _ in range(120)]
    odd = ["a  b\ta b\na b\x0ba b", "x" * 5, "é " * 9, "A a A a A a A a", "           ", "\x1c \x1c \x1c \x1c \x1c \x1c"]
    more = list(enumerate([*texts, *odd, None, ""], 1000))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((tuple(r) for r in periodic_runs.digest_runs(table).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = sorted((digest(k, t) for k, t in [*((r[0], r[1]) for r in rows if (r[1] or "").count(" ") < 8000), *more]), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r for r in got if r[0] != 85] == want and sum(r[1] > 0 for r in want) > 20
    assert periodic_runs.digest_runs(none).count() == 0
    kept = periodic_runs.periodic_runs(docs.withColumn("runs", F.lit(1)))
    assert kept.columns == [*docs.columns, "n_words", "runs", "collapsed"] and kept.count() == len(rows)
