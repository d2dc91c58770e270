"""Operators that link rows, against brute force."""

import numpy as np
import pytest

from bytelake.llm import common, embedding_dedup, jaccard_join


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def closure(ids, linked):
    comp = {i: i for i in ids}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in ids if linked(i, j))]) for i in ids}
        if new == comp:
            return comp
        comp = new


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, rows, size, percent):
    sets = {r[0]: shingles(r[1], size) for r in rows if r[0] is not None}
    link = {(a, b): bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a in sets for b in sets}
    comp = closure(list(sets), lambda a, b: link[a, b])
    assert len(set(comp.values())) < len(comp) - 8
    got = jaccard_join.jaccard_components(docs, size=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id]), r
    kept = jaccard_join.drop_near_copies(docs, size=size, percent=percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in comp.items() if i == c} | {None}


def test_jaccard_empty(none):
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_prefixes_share_a_shingle(percent):
    """Sets at the threshold share one of their first elements, whatever their sizes and the order."""
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 5, 9, 10, 11, 40, 200, 999]:
        for _ in range(30):
            a = rng.permutation(5 * n)[:n]
            most = rng.integers(0, n * (100 - percent) // 100 + 2)
            b = np.unique(np.concatenate([a[most:], rng.integers(0, 5 * n, most)]))
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                first = [set(sorted(x.tolist())[: jaccard_join.prefix_size(len(x), percent)]) for x in (a, b)]
                assert first[0] & first[1]


def test_jaccard_of_common_prefixes(spark):
    """More near copies than a prefix shingle lists, in two families, with groups of identical prefixes."""
    import random

    rng = random.Random(4)
    rows = []
    for f in range(2):
        base = [f"f{f}w{i}" for i in range(60)]
        for i in range(90):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.choice((3, 20, 40, 55))] = f"v{rng.randrange(3)}"
            rows.append((100 * f + i, " ".join(w), "x"))
    rows += [(500, "a b c d e f g h i j k l", "x"), (501, "a b c d e f g h i j k l m", "x"), (501, rows[0][1], "x"), (502, "A  b\tc d e f g h i j k l", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    sets = {i: shingles(t, 3) for i, (_, t, _) in enumerate(rows)}
    ids = [r[0] for r in rows]
    link = [(a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    linked = set(link)
    comp = closure(list(sets), lambda a, b: (a, b) in linked)
    least = {c: min(ids[i] for i in sets if comp[i] == c) for c in comp.values()}
    got = [tuple(r) for r in jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted((ids[i], len(s), least[comp[i]]) for i, s in sets.items())
    assert len(least) > 4


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7001, 7000)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 201)} == {1} and {got[i] for i in range(1000, 1300)} == {1000}
    assert got[7001] == 7000 and 5000 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(260):
        base = rng.normal(size=16) if i % 4 == 0 else np.array(rows[i - i % 4][1]) + rng.normal(size=16) * 0.1 * (i % 4)
        rows.append((i, [float(x) for x in np.float32(base)], int(i // 4 % 2)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, rows[0][1], None), (304, None, 0), (305, [0.0] * 16, 0), (306, [float("nan")] * 16, 0)]
    rows += [(307, [], 0), (308, [1.0] + [None] * 15, 0), (309, [1.0, 2.0], 0), rows[3], (None, rows[0][1], 0)]
    hub = rng.normal(size=16)
    rows += [(1000 + i, [float(x) for x in np.float32(hub + rng.normal(size=16) * 0.02)], 5) for i in range(300)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, k int, vec string")
    fit = {r[0]: (np.array(r[1], float) / np.linalg.norm(r[1]), r[2]) for r in rows if r[0] is not None and r[1] and None not in r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])}
    ids = sorted({r[0] for r in rows if r[0] is not None})

    def linked(a, b):
        return a != b and a in fit and b in fit and fit[a][1] == fit[b][1] and len(fit[a][0]) == len(fit[b][0]) and fit[a][0] @ fit[b][0] >= 0.98

    near = {a: {b for b in fit if linked(a, b)} if a in fit else set() for a in ids}
    comp = closure(ids, lambda a, b: b in near[a])
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == len(ids) + 1 and got[None].component_id is None
    found = sum(got[i].n_links for i in ids)
    assert 0.98 * sum(map(len, near.values())) <= found <= sum(map(len, near.values()))
    assert all(got[i].n_links <= len(near[i]) for i in ids)
    assert sum(got[i].component_id == comp[i] for i in ids) >= 0.98 * len(ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert got[301].n_links >= 2 and got[302].n_links == got[304].n_links == got[305].n_links == 0
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_near_vectors_of_real_width(spark):
    """Recall of links from 0.98 on, at 64 dimensions and in double precision, against all pairs."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([b + rng.normal(size=(4, 64)) * rng.uniform(0.02, 0.2) for b in base])
    rows = np.concatenate([base, near])
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & ~np.eye(len(rows), dtype=bool)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    assert linked.sum() > 500 and all(got[i] <= n for i, n in enumerate(linked.sum(1)))
    assert sum(got.values()) >= 0.99 * linked.sum()


def counted_cells(monkeypatch):
    """Rows that meet in cells of verification, by stage."""
    seen, plain = [], common.run_groups

    def counting(df, *args, **more):
        seen.append(df.count())
        return plain(df, *args, **more)

    monkeypatch.setattr(common, "run_groups", counting)
    return seen


@pytest.mark.parametrize(("heads", "rounds", "block"), [(8, 12, 256), (1, 1, 3), (2, 3, 4), (8, 0, 5)])
def test_lists_of_several_clusters(spark, monkeypatch, heads, rounds, block):
    """Boilerplate of six kinds that share most of their text, in clusters, chains and single documents."""
    for name, value in (("LISTED", 2), ("HEADS", heads), ("ROUNDS", rounds), ("BLOCK", block)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(12)
    common_part = [f"c{i}" for i in range(40)]
    texts = []
    for kind in range(6):
        base = [*common_part, *(f"k{kind}w{i}" for i in range(18))]
        for i in range(14):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 40)}"
            texts.append(" ".join(w[: int(rng.integers(46, 59))]))
    texts += [" ".join(rng.permutation(common_part)) for _ in range(8)]
    sets = [shingles(t, 2) for t in texts]
    comp = closure(range(len(sets)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert 8 < len(set(comp.values())) < len(texts) - 20
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2, percent=80).collect()}
    assert got == comp


def test_copies_of_one_licence_text_stay_few(spark, monkeypatch):
    """6,000 documents of one text with words of their own: sets meet in cells a bounded number of times, not with each other."""
    seen = counted_cells(monkeypatch)
    base = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(1)
    rows = []
    for i in range(6000):
        w = list(base)
        for j in rng.integers(0, 200, 2):
            w[j] = f"x{rng.integers(0, 300)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=3, percent=80).collect()
    assert len(got) == 6000 and {r.component_id for r in got} == {0}
    assert len(seen) == 2 and sum(seen) < 16 * 6000, seen  # one round


def test_a_rounds_pairs_grow_with_the_sets(spark):
    """200 sets in each of 50 lists make no more than HEADS pairs each, not HEADS for each list."""
    rows = [(h, k, 100, k, 0) for h in range(50) for k in range(200)]
    open_ = spark.createDataFrame(rows, "h long, k long, n long, c long, main long")
    pairs = jaccard_join.head_pairs(open_, 80, 0, False)
    found = pairs.collect()
    assert len({r.b for r in found}) == 200 and len(found) <= 200 * jaccard_join.HEADS
    assert len({r.a for r in found}) <= jaccard_join.HEADS
    assert jaccard_join.head_pairs(open_, 80, 0, True).count() > 40 * len(found)
