"""Ranked lexical search: one scan of the documents by an Aho-Corasick automaton of all query terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Documents returned for each item.
TOP = 20
#: Bytes of terms (repeats between items included) that a block of items may hold, if it holds several items.
BLOCK_BYTES = 4 << 20
#: (document, term, item) meetings and (document, item) scores that a task works on at once.
CELLS = 1 << 21
#: Salts of the first of two rankings, so that no task gets all that tasks return for one item.
SALTS = 32

# What separates terms becomes a space, A-Z become small, all other bytes stay.
_BYTES = bytes(ord(c.lower()) if (c := chr(b)).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def guarded(text: str | None) -> tuple[str, int]:
    """The text's terms with one space before, between and after them (each byte a character), and their number."""
    terms = text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []
    return (" " + b" ".join(terms).decode("latin-1") + " " if terms else ""), len(terms)


def automaton(terms: list[str]) -> ahocorasick.Automaton | None:
    """Finds the terms between spaces, as their number in the list. Neighbours share the space between them."""
    if not terms:
        return None
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t} ", i)
    found.make_automaton()
    return found


def term_frequencies(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, n, terms, tfs) from docs(doc_id, t): number of terms of a document and, for those of the broadcast list
    that it holds, their numbers and frequencies, from one scan of its text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(terms.value)
        for rb in C.pieces(batches):
            sizes, at, own, tfs = [], [0], [], []
            for text in rb.column(1).to_pylist():
                s, n = guarded(text)
                seen = Counter([i for _, i in find.iter(s)]) if find and n else {}
                sizes.append(n)
                own.extend(seen)
                tfs.extend(seen.values())
                at.append(len(own))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, kind)) for v, kind in ((own, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(go, "doc_id long, n long, terms array<int>, tfs array<bigint>")


class Best:
    """The `top` highest scores of each item so far, equal scores by ascending doc_id."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least, self.held = top, np.ones(items, np.int64), [np.empty(0, np.int64)] * 3
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each document, a column for each item."""
        row, item = np.nonzero(scores >= self.least)
        self.new.append((item, scores[row, item], ids[row]))
        self.waiting += len(row)
        if self.waiting > CELLS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, ids = (np.concatenate([x, *(n[i] for n in self.new)]) for i, x in enumerate(self.held))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.top - 1
        self.least[item[last]] = score[last]
        self.held, self.new, self.waiting = [x[place < self.top] for x in (item, score, ids)], [], 0
        return tuple(self.held)


def _score(counted: DataFrame, sent, documents: int, length: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): of each task's documents the best `top` of every item.

    sent: item ids, for each term its weight and the items that hold it with how often (as offsets, items, times), and
    whether all sums stay below 2**53, so that doubles add them exactly.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w, at, of, times, doubles = sent.value
        best = Best(len(items), top)
        for rb in C.pieces(batches):
            ids, n = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            terms, tfs = rb.column(2), rb.column(3)
            ends = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            term, tf = (np.asarray(x.flatten().to_numpy(), np.int64) for x in (terms, tfs))
            m = 75 + 25 * n * documents // length
            value = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(ends))))
            fan = at[term + 1] - at[term]
            met = np.concatenate([[0], np.cumsum(fan)])[ends]
            a = 0
            while a < len(ids):  # as many documents as CELLS allows, one at least
                b = min(np.searchsorted(met, met[a] + CELLS, "right") - 1, a + CELLS // len(items))
                b = min(max(b, a + 1), len(ids))
                here = slice(ends[a], ends[b])
                f = fan[here]
                # the places in `of` of each term, one after the other
                p = np.arange(f.sum()) + np.repeat(at[term[here]] - np.concatenate([[0], np.cumsum(f)[:-1]]), f)
                cell = np.repeat(np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), f) * len(items) + of[p]
                part = np.repeat(value[here], f) * times[p]
                if doubles:
                    scores = np.bincount(cell, part, (b - a) * len(items)).astype(np.int64)
                else:
                    scores = np.zeros((b - a) * len(items), np.int64)
                    np.add.at(scores, cell, part)
                best.add(ids[a:b], scores.reshape(b - a, len(items)))
                a = b
        item, score, ids = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(items[item]), pa.array(ids), pa.array(score)], ["item_id", "doc_id", "score"])

    return counted.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(go, "item_id long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) from items(item_id, t)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in C.pieces(batches):
            rows = [(k, t, c) for k, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True) for t, c in Counter(guarded(text)[0].split(" ")).items() if t]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], ["item_id", "term", "times"])

    return items.mapInArrow(go, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _blocks(terms: DataFrame) -> tuple[DataFrame, int]:
    """terms with a column block, and the number of blocks: none has more than BLOCK_BYTES of terms, unless it is one item."""
    sized = terms.groupBy("item_id").agg(F.sum(F.length("term") + 8).alias("size"))
    items, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(1, math.ceil(total / BLOCK_BYTES)) if items else 0
    dealt = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n)) if n > 1 else F.lit(0)
    while n > 1 and n < 1 << 20 and sized.groupBy(dealt(n).alias("block")).agg(F.sum("size").alias("s"), F.count("*").alias("c")).where((F.col("s") > BLOCK_BYTES) & (F.col("c") > 1)).limit(1).count():
        n *= 2
    return (terms.withColumn("block", dealt(n)), n) if items else (terms, 0)


def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the `top` documents with the highest scores above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. With N documents that
    hold a term, L terms in all, n of a document, df documents holding a term and tf occurrences in one document, a
    term weighs w = floor(1000 * ln((2N+2) / (2df+1))), and a document scores the sum, over the item's terms with
    repeats, of w * (10**9 tf div (1000 tf + 12 m)), where m = 75 + 25 n N div L. Equal scores rank by ascending doc_id.

    All terms of the items make up one automaton, in which each term stands between spaces, so that only whole terms
    match. It is broadcast (a block of items at a time, BLOCK_BYTES of terms or a single item) and counts tf in one scan
    of each text, without an index of the documents; what it finds is written, a list of numbers a document. Weights
    come from the document frequencies of the items' terms. Each task scores its documents for all items through the
    items that its terms belong to and returns `top` rows an item at most; these are ranked in two steps.

    Every row of docs is a document, repeated rows too; null or empty texts have no terms and count nowhere. Rows with a
    null doc_id count in N, L and df but aren't returned. Repeated rows of items count once, different texts of one
    item_id are one item with the terms of all; null item ids and items without terms give no rows. Other columns are
    ignored, whatever their names. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t")).where("item_id IS NOT NULL").distinct()
    terms, blocks = _blocks(C.materialize(_item_terms(asked)))
    found = None
    for block in range(blocks):
        rows = terms.where(F.col("block") == block).select("item_id", "term", "times").orderBy("term", "item_id").toArrow()
        if not rows.num_rows:
            continue
        column = rows.column("term").combine_chunks().dictionary_encode()
        vocabulary, term = column.dictionary.to_pylist(), column.indices.to_numpy()
        own, item = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
        times = rows.column("times").to_numpy()
        counted, seen = C.materialize(term_frequencies(base, spark.sparkContext.broadcast(vocabulary)), F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L"))
        if not seen["N"]:
            continue
        df = np.zeros(len(vocabulary))
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for each term of the block at most
        df[held["term"].to_numpy()] = held["df"].to_numpy()
        w = np.array([math.floor(1000 * math.log((2 * seen["N"] + 2) / (2 * x + 1))) for x in df], np.int64)
        at = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        most = int(w.max()) * 1_000_000 * int(np.bincount(item, times).max())
        sent = spark.sparkContext.broadcast((own, w, at, item, times, most < 1 << 53))
        best = _score(counted, sent, seen["N"], seen["L"], top)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    for keys in (["item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The rows of rank_documents over documents and benchmark.
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), a GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
