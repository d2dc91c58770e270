"""N-gram Jaccard join: documents whose sets of word shingles overlap almost fully, by a grouped prefix join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Shingles whose scrambled hash is below this part of the hash space are counted, and come first in the order.
COUNTED = 0.5
#: Documents behind a prefix shingle up to which its group pairs are listed; those behind more common ones are joined in
#: rounds, at most ROUNDS, and what these leave in blocks.
LISTED, ROUNDS, BLOCK = 64, 12, 256
#: Sets of such a shingle that all others of other components are compared with in a round.
HEADS = 4
#: Partners in a cell of verification.
CELL = 64
#: Bits of the bitmap that thins out shingles of one document before they are joined to the counts: 8 MB.
SEEN_BITS = 1 << 26
#: Bits of the bitmap that thins out sets before those of some pairs are joined: 2 MB.
PAIR_BITS = 1 << 24
_COUNTED = np.uint64(int(COUNTED * 2.0**64))
_ORDER = np.uint64(0x5851F42D4C957F2D)


def prefix_size(n: int, percent: int) -> int:
    """First shingles of a set of n, in an order common to all, of which a set that links holds one at least among its own first."""
    return n - -(-percent * n // 100) + 1


def _count_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(h, c): in how many of the texts (column t) each counted shingle is; only those in two or more."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for rb in C.pieces(batches):
            sets = [C.shingle_set(C.hash_words(t, hashes), size) for t in rb.column(0).to_pylist()]
            if sets:
                s = np.concatenate(sets)
                h, c = np.unique(s[C.mix(s ^ _ORDER) < _COUNTED], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(h)), pa.array(c)], ["h", "c"])

    return texts.select("t").mapInArrow(go, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")


def _sets(texts: DataFrame, size: int, percent: int, sent) -> DataFrame:
    """From (k, t, x, y): k, x, y, the set's size n and 128-bit digest (hi, lo). For sets that may link, also first
    (the prefix's size), counted (how many are), seen (counted shingles that other sets may hold), rest (uncounted
    ones as far as the prefix may reach) and own_set: a set with a whole prefix of shingles of its own can't link.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for rb in C.pieces(batches):
            cols: list[list] = [[] for _ in range(8)]
            for t in rb.column(1).to_pylist():
                s = C.shingle_set(C.hash_words(t, hashes), size)
                sig, n = xxhash.xxh3_128_digest(s.tobytes()), len(s)
                row = [n, int.from_bytes(sig[:8], "little", signed=True), int.from_bytes(sig[8:], "little", signed=True), None, None, None, None, None]
                if n:
                    order, first = C.mix(s ^ _ORDER), prefix_size(n, percent)
                    counted = order < _COUNTED
                    own, mine = s[counted], int(counted.sum())
                    seen = own[C.hits(sent.value, C.signed(own))]
                    if mine - len(seen) < first:
                        rest = s[~counted][np.argsort(order[~counted], kind="stable")[: max(0, first - mine)]]
                        row[3:] = [first, mine, C.signed(seen), C.signed(rest), s.tobytes()]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(2), rb.column(3), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))],
                ["k", "x", "y", "n", "hi", "lo", "first", "counted", "seen", "rest", "own_set"],
            )

    return texts.select("k", "t", "x", "y").mapInArrow(
        go, "k long, x long, y long, n long, hi long, lo long, first long, counted long, seen array<bigint>, rest array<bigint>, own_set binary"
    )


def _groups(near: DataFrame, counts: DataFrame) -> DataFrame:
    """(k, n, g, own, prefix) of the sets that may link: the shingles of the prefix that other sets hold, by rising
    frequency, after `own` ones of this set alone. Sets with identical prefixes and size have one g."""
    rows = near.select("k", "n", "first", "counted", "rest", F.explode_outer("seen").alias("h")).join(counts, "h", "left")
    keys = ["k", "n", "first", "counted", "rest"]
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.when(F.col("c").isNotNull(), F.struct("c", "h")))).alias("seen"))
    rows = rows.withColumn("own", F.col("counted") - F.size("seen")).where("own < first")
    rows = rows.withColumn("prefix", F.slice(F.concat(F.col("seen.h"), "rest"), F.lit(1), (F.col("first") - F.col("own")).cast("int")))
    alone = F.xxhash64(F.lit("alone"), "k")
    return rows.select("k", "n", F.when(F.col("own") == 0, F.xxhash64("n", "prefix")).otherwise(alone).alias("g"), "own", "prefix").where(F.size("prefix") > 0)


def _fits(percent: int, both, na, nb):
    """Whether an overlap of `both` is enough for sizes na and nb."""
    return both * (100 + percent) >= percent * (na + nb)


def _group_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (ga, gb) of groups that share a listed prefix shingle, filtered by size and position; a group of
    several documents is a pair with itself.

    Before a shared shingle no more than the shorter beginning can be shared, after it no more than the shorter
    rest. Shingles shared up to the last one are counted, with a group's common shingles, which aren't listed here.
    """
    a = posts.select("h", *(F.col(c).alias(f"{c}a") for c in ("g", "n", "m", "pos", "common")))
    b = posts.select("h", *(F.col(c).alias(f"{c}b") for c in ("g", "n", "m", "pos", "common")))
    each = (F.col("ga") < F.col("gb")) | ((F.col("ga") == F.col("gb")) & (F.col("ma") > 1))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    after = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    near = a.join(b, (a["h"] == b["h"]) & each & sizes & _fits(percent, after + F.least("posa", "posb"), F.col("na"), F.col("nb")))
    pairs = near.groupBy("ga", "gb", "na", "nb", "commona", "commonb").agg(F.count("*").alias("shared"), F.max("posa").alias("posa"), F.max("posb").alias("posb"))
    most = F.col("shared") + F.least("commona", "commonb") + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) - 1
    return pairs.where(_fits(percent, most, F.col("na"), F.col("nb"))).select("ga", "gb")


def _verify_partners(percent: int):
    """Links of a cell's first document (the row with role 0) to its partners."""

    def f(tb: pa.Table) -> dict | None:
        role, ids = tb.column("role").to_numpy(), tb.column("k").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in tb.column("own_set").to_pylist()]
        found = []
        for i in np.flatnonzero(role == 0):
            for j in np.flatnonzero(role == 1):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * (100 + percent) >= percent * (len(sets[i]) + len(sets[j])):
                    found.append((ids[i], ids[j]))
        return {"a": np.array([x[0] for x in found]), "b": np.array([x[1] for x in found])} if found else None

    return f


def verify(percent: int):
    """Links among the documents of a cell of blocks (see common.block_pairs), as a forest."""

    def f(tb: pa.Table) -> dict | None:
        if tb.num_rows < 2:
            return None
        ids, n, own = (tb.column(c).to_numpy() for c in ("k", "n", "own"))
        fits = 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
        if tb.column("bi")[0] != tb.column("bj")[0]:
            fits &= own[:, None] != own[None, :]
        np.fill_diagonal(fits, False)
        use = np.flatnonzero(fits.any(1))
        if not len(use):
            return None
        sets = [np.frombuffer(tb.column("own_set")[int(i)].as_py(), np.uint64) for i in use]
        _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(use)), [len(s) for s in sets])
        dense = np.cumsum(seen > 1) - 1
        row, col = row[seen[col] > 1], dense[col[seen[col] > 1]]
        both = np.zeros((len(use), len(use)), np.float64)
        for at in range(0, int(dense[-1]) + 1, 8192):
            here = (col >= at) & (col < at + 8192)
            m = np.zeros((len(use), min(8192, int(dense[-1]) + 1 - at)), np.float32)
            m[row[here], col[here] - at] = 1
            both += m @ m.T
        k = n[use]
        both = both.astype(np.int64)
        linked = fits[np.ix_(use, use)] & (100 * both >= percent * (k[:, None] + k[None, :] - both))
        if not linked.any():
            return None
        a, b = C.forest(ids[use], linked)
        return {"a": a, "b": b}

    return f


def _links(near: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Verified edges (a, b) between sets, enough to join all that link, from near(k, ...), k the set's digest."""
    members = C.materialize(_groups(near, counts))
    groups = members.groupBy("g").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("prefix").alias("prefix"), F.count("*").alias("m"))
    posts = groups.select("g", "n", "m", "own", F.posexplode("prefix").alias("i", "h")).select("g", "n", "m", "h", (F.col("own") + F.col("i")).alias("pos"))
    lists = posts.groupBy("h").agg(F.sum("m").alias("w")).where("w > 1")
    posts, seen = C.materialize(posts.join(lists, "h"), F.count(F.when(F.col("w") > LISTED, 1)).alias("many"))
    many = posts.where(F.col("w") > LISTED)
    common = many.groupBy("g").agg(F.count("*").alias("common"))
    listed = posts.where(F.col("w") <= LISTED).join(common, "g", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    pairs = C.materialize(_group_pairs(listed, percent))
    of = members.select("g", "k")
    expanded = pairs.join(of.select(F.col("g").alias("ga"), F.col("k").alias("ka")), "ga").join(of.select(F.col("g").alias("gb"), F.col("k").alias("kb")), "gb")
    expanded = expanded.where("ka != kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
    expanded = C.materialize(expanded)
    sets = near.select("k", "n", "own_set")
    edges = C.materialize(partner_links(expanded, sets, percent))
    if seen["many"]:
        edges = common_links(many.select("h", "g"), members.select("g", "k", "n"), sets, edges, percent)
    C.release(members, posts, pairs, expanded)
    return edges


def partner_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by cells of one set a and CELL partners at most. Only sets that pairs name are moved."""
    sets = C.reduce_by_bitmap(sets, "k", pairs.select(F.explode(F.array("a", "b")).alias("k")), PAIR_BITS)
    chunks = F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("chunks")
    size = pairs.groupBy("a").agg(chunks)
    partner = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b", F.lit(7)), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("k"), F.lit(1).alias("role"))
    first = size.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("k"), F.lit(0).alias("role"))
    cells = partner.unionByName(first).join(sets, "k").select("a", "chunk", "role", "k", "own_set")
    return C.run_groups(cells, ["a", "chunk"], _verify_partners(percent), "a long, b long", ["a", "b"])


def head_pairs(open_: DataFrame, percent: int, turn: int, every: bool) -> DataFrame:
    """Pairs (a, b) of a round, from open_(h, k, n, c, main): a set with the HEADS heads of one of its lists, or with those of
    every one. A set's list is that of least hash, so that sets with many lists in common mostly take the same one."""
    head = F.min_by(F.struct("k", "n", "c"), F.xxhash64("k", F.lit(turn)))
    heads = open_.where("c != main").groupBy("h", F.pmod(F.xxhash64("k", F.lit(-1 - turn)), F.lit(HEADS))).agg(head.alias("head")).select("h", "head")
    one = F.min_by(F.struct("h", "n", "c"), F.xxhash64("h", F.lit(turn)))
    own = open_.select("h", "k", "n", "c") if every else open_.groupBy("k").agg(one.alias("one")).select("one.h", "k", "one.n", "one.c")
    fits = 100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n")
    return own.join(heads, "h").where((F.col("c") != F.col("head.c")) & fits).select(F.col("head.k").alias("a"), F.col("k").alias("b"))


def common_links(many: DataFrame, members: DataFrame, sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """edges (which it releases) with what joins the sets that share a common prefix shingle, from many(h, g) and
    members(g, k, n).

    Only components are wanted, so sets that are joined already needn't be compared. A round compares, in each list that
    holds several components, HEADS sets outside its largest component with all sets of other components: a few copies of a
    set, whatever the list's length. Boilerplate that differs in some words is one component after the first round. Heads are
    those of least hash, so that lists of the same documents have the same ones. At first a set meets the heads of one of its
    lists alone, so that a round's pairs grow with the sets and not with the shingles they share; when such a round leaves
    more than three quarters outside the largest components, those of all its lists. What a round of this kind leaves so is
    compared with the whole list, in blocks.
    """
    rows = C.materialize(many.join(members, "g").select("h", "k", "n").distinct())

    def opened(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
        """(h, k, n, c, main) of the lists that hold several components c, and the rows outside the largest one, main."""
        labels = C.components(edges).select(F.col("id").alias("k"), F.col("component").alias("c"))
        own = C.materialize(rows.select("h", "k", "n").join(labels, "k", "left").withColumn("c", F.coalesce("c", "k")))
        sizes = own.groupBy("h", "c").agg(F.count("*").alias("m"))
        main = sizes.groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("h", "main")
        found, seen = C.materialize(own.join(main, "h"), F.count(F.when(F.col("c") != F.col("main"), 1)).alias("n"))
        C.release(labels, own)
        return found, seen["n"]

    (open_, n), before, every = opened(rows, edges), None, False
    C.release(rows)
    for turn in range(ROUNDS):
        if not n:
            break
        if before is not None and 4 * n > 3 * before:
            if every:
                break
            every = True
        pairs = C.materialize(head_pairs(open_, percent, turn, every).distinct())
        new = C.materialize(edges.unionByName(partner_links(pairs, sets, percent)))
        C.release(edges, pairs)
        edges, before, last = new, n, open_
        open_, n = opened(last, edges)  # a list of one component stays so
        C.release(last)
    if not n:
        C.release(open_)
        return edges
    # Lists that share a set are one family; in it, sets outside the largest component meet all others.
    heads = open_.groupBy("h").agg(F.min("k").alias("head"))
    families = C.components(open_.join(heads, "h").select("k", "head").distinct(), "k", "head").select(F.col("id").alias("k"), F.col("component").alias("fam"))
    kin = open_.select("k", "c").distinct().join(families, "k", "left").withColumn("fam", F.coalesce("fam", "k"))
    kin = C.materialize(kin)
    main = kin.groupBy("fam", "c").agg(F.count("*").alias("m")).groupBy("fam").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(BLOCK))).cast("int")
    kin = kin.join(main, "fam").withColumns({"few": F.col("all") - F.col("most")}).withColumns({"nu": blocks("few"), "nb": blocks("all")})
    place = lambda n, salt: F.pmod(F.xxhash64("k", "fam", F.lit(salt)), n).cast("int")
    every = kin.select("k", "fam", place(F.col("nb"), 1).alias("bj"), F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("bi"), F.lit(1).alias("own"))
    outside = kin.where("c != main").select("k", "fam", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bj"), place(F.col("nu"), 2).alias("bi"), F.lit(0).alias("own"))
    cells = every.unionByName(outside.select(*every.columns)).withColumn("bj", F.col("bj") + F.lit(1) + F.col("bi"))  # never equal to bi
    sets = C.reduce_by_bitmap(sets, "k", open_.select("k"), PAIR_BITS)
    cells = cells.join(sets, "k").select("fam", "bi", "bj", "own", "k", "n", "own_set")
    found = C.materialize(edges.unionByName(C.run_groups(cells, ["fam", "bi", "bj"], verify(percent), "a long, b long", ["a", "b"])))
    C.release(edges, open_)
    return found


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set is its distinct `size`-word shingles (A-Z lower-cased, ASCII white space); with fewer words
    the whole sequence is one shingle; null or wordless text has an empty set and links with nothing. Two
    documents link when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    Rows with a null doc_id keep their n_shingles and get a null component. Repeated rows come back repeated; rows
    of one doc_id with different texts are judged each, as if they were different documents. Other columns are ignored, whatever their names. An empty
    table gives no rows.

    Equal texts, then equal sets, are judged once. Shingles are ordered by rising number of sets that hold them
    (half of the hash space is counted, over all documents; the other half comes after it by hash: any order that
    is the same for all sets is sound). Sets that link share a shingle of their prefixes in that order, so a set
    with a prefix of its own drops out. Sets with identical prefixes and size are one group; pairs of groups that
    share a prefix shingle are filtered by size and position, then expanded to members and verified exactly.
    Shingles that the prefixes of more than LISTED documents hold list no pairs: as only components are wanted, their
    documents are compared with one of them in each round, and only what stays outside the largest component of such a
    shingle's documents is compared with all of them, in blocks of bounded size. Components are drawn over verified links only. Shingles are compared by 64-bit hashes.
    """
    return text_components(docs, doc_id, text, size, percent).drop("x")


def text_components(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The rows of jaccard_components with the xxhash64 of their text, x."""
    base = docs.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    base = base.withColumns({"x": F.xxhash64("t"), "y": F.xxhash64(F.lit(1), "t")})
    rows = C.materialize(base.select("k", "x", "y"))
    first = rows.where("k IS NOT NULL").groupBy("x", "y").agg(F.min("k").alias("rep"))
    again = rows.join(first, ["x", "y"]).where("k != rep").select("k", "x")
    texts = C.drop_rows(base, again, ["k", "x"])
    counts = C.materialize(_count_shingles(texts.where("k IS NOT NULL"), size))
    sets = C.materialize(_sets(texts, size, percent, C.bitmap(counts, "h", SEEN_BITS)))
    reps = C.materialize(sets.where("n > 0 AND k IS NOT NULL").groupBy("hi", "lo").agg(F.min("k").alias("rep")))
    near = sets.where("own_set IS NOT NULL AND k IS NOT NULL")
    alike = near.select("k", "x", "hi", "lo").join(reps, ["hi", "lo"]).where("k != rep").select("k", "x")
    near = C.drop_rows(near, alike, ["k", "x"])
    links = _links(near.withColumn("k", F.col("hi")), counts, percent)
    comp = C.components(links).withColumnRenamed("id", "hi")
    C.release(counts, links)
    linked = comp.join(reps.select("hi", "rep"), "hi")
    linked = linked.select("hi", "component").join(linked.groupBy("component").agg(F.min("rep").alias("c")), "component").select("hi", "c")
    known = reps.join(linked, "hi", "left").select("hi", "lo", F.coalesce("c", "rep").alias("c"))
    of_text = sets.groupBy("x", "y").agg(F.first("n").alias("n"), F.first("hi").alias("hi"), F.first("lo").alias("lo")).join(known, ["hi", "lo"], "left")
    out = rows.join(of_text.select("x", "y", "n", "c"), ["x", "y"], "left")
    return out.select(
        F.col("k").alias("doc_id"),
        "x",
        F.col("n").alias("n_shingles"),
        F.when(F.col("k").isNull(), None).when(F.col("n") == 0, F.col("k")).otherwise(F.col("c")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Keep of each component the rows with the smallest doc_id, with all columns. Rows with a null doc_id stay. Of one
    doc_id's texts only those go that are in a component of a smaller id."""
    comp = text_components(docs, doc_id, text, size, percent).where("doc_id IS NOT NULL AND doc_id != component_id")
    return C.drop_texts(docs, comp.select("doc_id", "x"), doc_id, text)


#: The rows of jaccard_components over documents, at 3 words and 90 %.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY 1, 2
"""
