"""Counts of byte n-grams and what is selected from them.

A blob is one row, so its n-grams are counted where it is read, by a numpy helper. Nothing is shuffled before the counts;
content never is. Large blobs are worked on in chunks that overlap by n - 1 bytes, and their distinct n-grams in parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.functions import gram_key

#: Bytes of a blob worked on at once; n-grams of a blob whose distinct ones are held at once; rows of a batch sent back,
#: and of one of picked n-grams, which are Python objects from 8 bytes on.
CHUNK, PART, ROWS, PICKED_ROWS = 1 << 20, 1 << 24, 1 << 18, 1 << 14
#: Longest n-grams that are packed into a long; longer ones are grouped by a hash, and are binary.
PACKED = 7
#: Document frequencies that each task holds (16 bytes each): the largest.
HEAVY = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: Distinct n-grams as keys (packed, or hashes), their counts and first positions.
Counted = tuple[np.ndarray, np.ndarray, np.ndarray]


def content_of(rb: pa.RecordBatch, column: int = 1) -> Iterator[np.ndarray]:
    """Each row's bytes where they lie, without a copy; null is empty."""
    for x in rb.column(column):
        yield np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8)


def packed_grams(b: np.ndarray, n: int) -> np.ndarray:
    """All n-grams in order, packed big-endian."""
    m = len(b) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    g = b[:m].astype(np.int64)
    for k in range(1, n):
        g <<= 8
        g |= b[k : k + m]
    return g


def hashed_grams(b: np.ndarray, n: int, factor: np.uint64 = _FACTOR) -> np.ndarray:
    """A 64-bit hash of each n-gram, in order, by doubling: two neighbouring hashes make the next."""
    m = len(b) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    power, size, h, done, out = factor, 1, b.astype(np.uint64) + np.uint64(1), 0, np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out = out * power + h[done : done + m]
                done += size
            if 2 * size > n:
                break
            h, size = h[:-size] * power + h[size:], 2 * size
            power = power * power
    return out.view(np.int64)


def _keys(b: np.ndarray, n: int) -> np.ndarray:
    return packed_grams(b, n) if n <= PACKED else hashed_grams(b, n)


class _Collision(Exception):
    pass


def _check(b: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> None:
    """Raise if the n-grams at places i and j, of equal hash, differ."""
    if n > PACKED and not all((b[i + k] == b[j + k]).all() for k in range(n)):
        raise _Collision


def _merge(b: np.ndarray, n: int, found: list[Counted]) -> Counted:
    key, c, first = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, key))
    key, c, first = key[order], c[order], first[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    _check(b, n, first, np.repeat(first[new], np.diff(np.append(new, len(key)))))
    return key[new], np.add.reduceat(c, new) if len(new) else c, first[new]


def _distinct(key: np.ndarray, n: int) -> Counted:
    """Distinct keys, counts and first places. Short n-grams are sorted together with their places, as one number."""
    if n == 1 and len(key) >= 256:
        counts, first = np.bincount(key, minlength=256), np.zeros(256, np.int64)
        first[key[::-1]] = np.arange(len(key) - 1, -1, -1)  # the last to be written is the first place
        u = np.flatnonzero(counts)
        return u, counts[u], first[u]
    if n > 5 or len(key) > 1 << 20 or not len(key):
        u, first, c = np.unique(key, return_index=True, return_counts=True)
        return u, c, first
    both = np.sort(key << 20 | np.arange(len(key)))
    key = both >> 20
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.diff(np.append(new, len(key))), both[new] & (1 << 20) - 1


def _chunk(b: np.ndarray, n: int, at: int, part: int, parts: int) -> Counted:
    """Distinct n-grams that begin in the chunk at a place, of one part of the keys."""
    key = _keys(b[at : at + CHUNK + n - 1], n)
    place = None
    if parts > 1:
        place = np.flatnonzero((key.view(np.uint64) * _FACTOR >> np.uint64(33)) % np.uint64(parts) == part)
        key = key[place]
    if n <= PACKED:
        u, c, first = _distinct(key, n)
    else:
        u, first, back, c = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        of = at + (np.arange(len(key)) if place is None else place)
        _check(b, n, of, of[first][back])
    return u, c, at + (first if place is None else place[first])


def _by_bytes(b: np.ndarray, n: int) -> Counted:
    """Without hashes: keys are numbers of distinct n-grams."""
    seen: dict[bytes, list[int]] = {}
    for i in range(len(b) - n + 1):
        seen.setdefault(b[i : i + n].tobytes(), [i, 0])[1] += 1
    first, c = np.array(list(seen.values()), np.int64).reshape(-1, 2).T
    return np.arange(len(first)), c, first


def counted_parts(b: np.ndarray, n: int) -> Iterator[Counted]:
    """Distinct n-grams of a blob with counts and first positions, in parts without n-grams in common: one, unless the
    blob has more than PART n-grams of 4 bytes or more.

    Up to 3 bytes, chunks add to a table of all values. Beyond, a part of the keys at a time is gathered from all chunks, so
    that memory is bounded by PART and CHUNK whatever the blob's size.
    """
    m = len(b) - n + 1
    if m <= 0:
        return
    if m > CHUNK and n <= 3:
        counts, first = np.zeros(1 << 8 * n, np.int64), np.zeros(1 << 8 * n, np.int64)
        step = max(CHUNK, len(counts) // 4)
        for at in reversed(range(0, m, step)):
            key = packed_grams(b[at : at + step + n - 1], n)
            counts += np.bincount(key, minlength=len(counts))
            first[key[::-1]] = np.arange(at + len(key) - 1, at - 1, -1)  # the last to be written is the first place
        u = np.flatnonzero(counts)
        yield u, counts[u], first[u]
        return
    parts = -(-m // PART)
    try:
        for part in range(parts):
            held, waiting = [], 0
            for at in range(0, m, CHUNK):
                held.append(_chunk(b, n, at, part, parts))
                waiting += len(held[-1][0])
                if waiting > max(4 * CHUNK, 2 * len(held[0][0])):
                    held = [_merge(b, n, held)]
                    waiting = len(held[0][0])
            yield _merge(b, n, held) if len(held) > 1 else held[0]
    except _Collision:
        if part:
            raise RuntimeError("two n-grams of one hash in a blob of several parts") from None
        yield _by_bytes(b, n)


def counted(b: np.ndarray, n: int) -> Counted:
    """Distinct n-grams of one blob, whole."""
    parts = list(counted_parts(b, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3


def _named(b: np.ndarray, n: int, key: np.ndarray, first: np.ndarray) -> pa.Array:
    """n-grams as they are sent back: longs, or from 8 bytes on binary."""
    return pa.array(key, pa.int64()) if n <= PACKED else pa.array([b[i : i + n].tobytes() for i in first.tolist()], pa.binary())


def _kind(n: int) -> str:
    if n < 1:
        raise ValueError("n must be 1 or more")
    return "long" if n <= PACKED else "binary"


def gram_counts(blobs: DataFrame, n: int = 3) -> DataFrame:
    """blob_id, n, packed, cnt, first_pos, total: overlapping n-grams of each blob; packed is a long, for n from 8 on
    binary. Blobs shorter than n give no rows. Rows are sent back in batches of ROWS."""
    kind = _kind(n)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held):
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held, strict=True)], ["blob_id", "packed", "cnt", "first_pos", "total"])

        held, rows = [], 0
        for rb in batches:
            for i, b in enumerate(content_of(rb)):
                for u, c, first in counted_parts(b, n):
                    for at in range(0, len(u), ROWS):
                        cut = slice(at, at + ROWS)
                        k = len(u[cut])
                        held.append((rb.column(0).take(pa.array(np.full(k, i))), _named(b, n, u[cut], first[cut]), pa.array(c[cut].astype(np.int64)), pa.array(first[cut].astype(np.int64)), pa.array(np.full(k, len(b) - n + 1, np.int64))))
                        rows += k
                        if rows >= ROWS:
                            yield send(held)
                            held, rows = [], 0
        if held:
            yield send(held)

    rows = blobs.select("blob_id", "content").mapInArrow(go, f"blob_id string, packed {kind}, cnt long, first_pos long, total long")
    return rows.withColumn("n", F.lit(n))


def gram_counts_builtin(blobs: DataFrame, n: int = 3) -> DataFrame:
    """The same as gram_counts by built-in functions alone: one row for each byte, then a shuffle."""
    kind = _kind(n)
    m = F.octet_length("content") - n + 1
    cut = blobs.where(m > 0).select("blob_id", m.cast("long").alias("total"), F.posexplode(F.transform(F.sequence(F.lit(1), m), lambda i: F.substring(F.col("content"), i, F.lit(n)))).alias("pos", "g"))
    rows = cut.groupBy("blob_id", "g").agg(F.count("*").alias("cnt"), F.min("pos").cast("long").alias("first_pos"), F.first("total").alias("total"))
    packed = F.conv(F.hex("g"), 16, 10).cast("long") if kind == "long" else F.col("g")
    return rows.select("blob_id", packed.alias("packed"), "cnt", "first_pos", "total", F.lit(n).alias("n"))


def ngram_counts(blobs: DataFrame, n: int = 3) -> DataFrame:
    """blob_id, n, gram (key such as 01_0a_ff), cnt, first_pos."""
    return gram_counts(blobs, n).select("blob_id", "n", gram_key("packed", n).alias("gram"), "cnt", "first_pos")


def ngram_stats(blobs: DataFrame, n: int) -> DataFrame:
    """total, unique, least and largest count of each blob; blobs without n-grams have zeros."""
    own = gram_counts(blobs, n).groupBy("blob_id").agg(F.sum("cnt").alias("total"), F.count("*").alias("distinct_grams"), F.min("cnt").alias("min_count"), F.max("cnt").alias("max_count"))
    return blobs.select("blob_id").join(own, "blob_id", "left").na.fill(0)


def _best(counts: DataFrame, k: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("blob_id").orderBy(*order, "first_pos"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def _first_of(value: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, in order, ties by first; only what is no less than the k-th is sorted."""
    if not 0 < k < len(value):
        return np.lexsort((first, -value))[:k]
    may = np.flatnonzero(value >= np.partition(value, len(value) - k)[len(value) - k])
    return may[np.lexsort((first[may], -value[may]))[:k]]


def ranked(c: np.ndarray, first: np.ndarray, total: int, k: int, strategy: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the k best n-grams of a blob, their scores and norms, by strategy: frequency or entropy."""
    if strategy == "frequency":
        best = _first_of(c, first, k)
        return best, c[best].astype(float), c[best] / max(total, 1)
    top = int(c.max(initial=0))
    own = np.arange(top + 1) if top < len(c) else c  # scores of counts, where these are fewer than n-grams
    p = own / max(total, 1)
    score = -p * np.log2(np.where(p > 0, p, 1)) + 0.0
    key = np.round(score, 12)  # equal shares tie, whatever the last bits
    if top < len(c):
        score, key = score[c], key[c]
    best = _first_of(key, first, k)
    return best, score[best], score[best] / np.log2(total) if total > 1 else np.zeros(len(best))


def best_of(b: np.ndarray, n: int, k: int, strategy: str) -> tuple[Counted, np.ndarray, np.ndarray, int, float]:
    """The k best n-grams of one blob, their scores and norms, and the number and sum of squared shares of all its distinct
    ones."""
    return best_of_parts(counted_parts(b, n), max(len(b) - n + 1, 0), k, strategy)


def best_of_parts(parts: Iterable[Counted], total: int, k: int, strategy: str) -> tuple[Counted, np.ndarray, np.ndarray, int, float]:
    """best_of, from the parts of a blob's distinct n-grams and its number of all."""
    best, distinct, squares = [], 0, 0.0
    for u, c, first in parts:
        at, score, norm = ranked(c, first, total, k, strategy)
        best.append((u[at], c[at], first[at]))
        distinct += len(u)
        squares += float(((c / total) ** 2).sum())
    if len(best) == 1:
        return best[0], score, norm, distinct, squares
    u, c, first = (np.concatenate(x) for x in zip(*best, strict=True)) if best else (np.empty(0, np.int64),) * 3
    at, score, norm = ranked(c, first, total, k, strategy)
    return (u[at], c[at], first[at]), score, norm, distinct, squares


def best_grams(blobs: DataFrame, n: int, k: int, strategy: str = "frequency") -> DataFrame:
    """blob_id, packed, cnt, first_pos, rank, score, norm of the k best n-grams of each blob, picked where it is read:
    only they leave the helper, and nothing is shuffled. The same rows as select_frequency or select_entropy."""

    def one(b: np.ndarray):
        (u, c, first), score, norm, *_ = best_of(b, n, k, strategy)
        return u, c, first, score, norm

    return _picked(blobs, n, one, ["score", "norm"])


def _picked(blobs: DataFrame, n: int, one: Callable, measures: list[str]) -> DataFrame:
    """blob_id, packed, cnt, first_pos, rank and measures of what one(bytes) picks of each blob, in order."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty():
            return [], [], [[] for _ in range(3 + len(measures))], 0

        for rb in batches:
            ids, packed, cols, rows = empty()
            for i, b in enumerate(content_of(rb)):
                u, c, first, *rest = one(b)
                ids.append(np.full(len(u), i))
                packed.append(_named(b, n, u, first))
                for col, x in zip(cols, (c, first, np.arange(1, len(u) + 1), *rest), strict=True):
                    col.append(x)
                rows += len(u)
                if rows >= PICKED_ROWS or i + 1 == rb.num_rows:
                    cat = [pa.array(np.concatenate(x).astype(t)) for x, t in zip(cols, [np.int64, np.int64, np.int32] + [float] * len(measures), strict=True)]
                    yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(np.concatenate(ids))), pa.concat_arrays(packed), *cat], ["blob_id", "packed", "cnt", "first_pos", "rank", *measures])
                    ids, packed, cols, rows = empty()

    return blobs.select("blob_id", "content").mapInArrow(go, f"blob_id string, packed {_kind(n)}, cnt long, first_pos long, rank int, " + ", ".join(f"{m} double" for m in measures))


def top_ngrams(blobs: DataFrame, n: int, k: int) -> DataFrame:
    """The k most frequent n-grams of each blob; ties by first occurrence."""
    return best_grams(blobs, n, k).select("blob_id", gram_key("packed", n).alias("gram"), "cnt", "first_pos", "rank")


def ngram_summary(counts: DataFrame) -> DataFrame:
    """blob_id with ngram_total_count, ngram_unique_count, ngram_diversity and ngram_distribution."""
    part = F.col("cnt") / F.col("total")
    own = counts.groupBy("blob_id").agg(F.sum("cnt").alias("t"), F.count("*").alias("u"), F.sum(part * part).alias("d"))
    return own.select(
        "blob_id",
        F.col("t").cast("double").alias("ngram_total_count"),
        F.col("u").cast("double").alias("ngram_unique_count"),
        (F.col("u") / F.col("t")).alias("ngram_diversity"),
        F.col("d").alias("ngram_distribution"),
    )


def select_frequency(counts: DataFrame, k: int) -> DataFrame:
    """blob_id, packed, rank, score (the count) and norm (by the total) of the k most frequent n-grams."""
    return _best(counts, k, F.desc("cnt")).select("blob_id", "packed", "rank", F.col("cnt").cast("double").alias("score"), (F.col("cnt") / F.col("total")).alias("norm"))


def select_entropy(counts: DataFrame, k: int) -> DataFrame:
    """The k n-grams with the largest -p log2 p; norm is by log2 of the total, 0 where that isn't positive."""
    p = F.col("cnt") / F.col("total")
    scored = counts.withColumn("score", -p * F.log2(p))
    scored = scored.withColumn("key", F.round("score", 12))  # equal shares tie, whatever the last bits
    norm = F.when(F.col("total") > 1, F.col("score") / F.log2(F.col("total").cast("double"))).otherwise(0.0)
    return _best(scored, k, F.desc("key")).select("blob_id", "packed", "rank", "score", norm.alias("norm"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """packed, df: the number of blobs that hold each n-gram."""
    return counts.groupBy("packed").agg(F.count("*").alias("df"))


def select_tfidf(counts: DataFrame, frequencies: DataFrame | None, documents: int, k: int) -> DataFrame:
    """The k n-grams with the largest tf * idf: tf is by the blob's largest count, idf ln((N + 1) / (df + 1)) + 1.
    Without frequencies, the k most frequent n-grams. No norm in either case."""
    if frequencies is None:
        return select_frequency(counts, k).drop("norm")
    top = F.max("cnt").over(Window.partitionBy("blob_id"))
    joined = counts.withColumn("top", top).join(frequencies, "packed", "left")
    idf = F.log(F.lit(documents + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    scored = joined.withColumn("score", F.col("cnt") / F.col("top") * idf).withColumn("key", F.round("score", 12))
    return _best(scored, k, F.desc("key")).select("blob_id", "packed", "rank", "score")


def gram_frequencies(blobs: DataFrame, n: int = 3) -> DataFrame:
    """packed, df, documents: in how many blobs each n-gram is, and the number of all blobs. Each task counts its blobs'
    n-grams before anything leaves it, so that an n-gram of all blobs is a row a batch and not a row a blob."""
    kind = _kind(n)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held):
            if n <= PACKED:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(c)], ["packed", "df"])
            both = pa.concat_arrays(held).value_counts()
            return pa.RecordBatch.from_arrays([both.field("values"), both.field("counts")], ["packed", "df"])

        blobs = 0
        for rb in batches:
            held, rows = [], 0
            for b in content_of(rb):
                blobs += 1
                for u, _, first in counted_parts(b, n):
                    held.append(u if n <= PACKED else _named(b, n, u, first))
                    rows += len(u)
                    if rows >= 16 * ROWS:
                        yield send(held)
                        held, rows = [], 0
            if held:
                yield send(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64() if n <= PACKED else pa.binary()), pa.array([blobs], pa.int64())], ["packed", "df"])

    own = blobs.select("blob_id", "content").mapInArrow(go, f"packed {kind}, df long").groupBy("packed").agg(F.sum("df").alias("df"))
    every = own.where("packed IS NULL").select(F.col("df").alias("documents"))  # one row
    return own.where("packed IS NOT NULL").join(F.broadcast(every), how="cross").select("packed", "df", "documents")


def best_tfidf(blobs: DataFrame, frequencies: DataFrame, n: int, k: int, documents: int | None = None) -> DataFrame:
    """blob_id, packed, cnt, first_pos, rank, score: the rows of select_tfidf, without a shuffle of all n-grams.

    frequencies(packed, df), with documents as gram_frequencies gives them or as a parameter, should be a written table.
    Its largest, HEAVY at most, go to every task. If these are all, the k best are picked where a blob is read. Else
    n-grams that aren't among them have a df from 0 up to the least of these, which bounds their scores: only those that
    may be among the k best leave the task, and their df is looked up by a join. No key of that join is frequent.
    """
    spark, kind = blobs.sparkSession, _kind(n)
    known, every = frequencies.agg(F.count("*"), F.max("documents") if documents is None else F.lit(documents)).first()
    every = every or 0
    heavy = frequencies.select("packed", "df")
    heavy = (heavy if known <= HEAVY else heavy.orderBy(F.desc("df"), "packed").limit(HEAVY)).toArrow()
    packed, df = heavy.column("packed"), heavy.column("df").to_numpy()
    least = int(df.min()) if known > HEAVY else 0
    if n <= PACKED:
        order = np.argsort(packed.to_numpy(), kind="stable")
        held = (packed.to_numpy()[order], df[order])
    else:
        held = dict(zip(packed.to_pylist(), df.tolist(), strict=True))
    sent = spark.sparkContext.broadcast(held)
    idf = lambda x: np.log((every + 1.0) / (x + 1)) + 1

    def look_up(b: np.ndarray, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        if n > PACKED:
            return np.array([sent.value.get(b[i : i + n].tobytes(), -1) for i in first.tolist()], np.int64)
        keys, values = sent.value
        if not len(keys):
            return np.full(len(u), -1)
        at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
        return np.where(keys[at] == u, values[at], -1)

    def one(b: np.ndarray):
        """What may be among the k best: all else is surely below k others."""
        top, out = max((int(c.max()) for _, c, _ in counted_parts(b, n)), default=1) if len(b) > CHUNK else 0, []
        for u, c, first in counted_parts(b, n):
            own = look_up(b, u, first)
            part = c / (top or c.max())
            sure = part * idf(np.where(own >= 0, own, least))
            out.append((u, c, first, own.astype(float), part, sure, np.where(own >= 0, sure, part * idf(0))))
            u, c, first, own, part, sure, may = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(u) > k:
                bar = np.partition(sure, len(sure) - k)[len(sure) - k] - 1e-11 if k else np.inf
                keep = may >= bar
                out = [(u[keep], c[keep], first[keep], own[keep], part[keep], sure[keep], may[keep])]
        if not out:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0),) * 3
        u, c, first, own, part, sure, _ = (np.concatenate(x) for x in zip(*out, strict=True))
        if known <= HEAVY:
            at = np.lexsort((first, -np.round(sure, 12)))[:k]
            return u[at], c[at], first[at], own[at], part[at], sure[at]
        return u, c, first, own, part, sure

    rows = _picked(blobs, n, one, ["own", "part", "sure"])
    if known <= HEAVY:
        return rows.select("blob_id", "packed", "cnt", "first_pos", "rank", F.col("sure").alias("score"))
    light = rows.where("own < 0").select("blob_id", "packed", "cnt", "first_pos", "part").join(frequencies.select("packed", "df"), "packed", "left")
    both = light.select("blob_id", "packed", "cnt", "first_pos", "part", F.coalesce("df", F.lit(0)).cast("double").alias("df"))
    both = both.unionByName(rows.where("own >= 0").select("blob_id", "packed", "cnt", "first_pos", "part", F.col("own").alias("df")))
    scored = both.withColumn("score", F.col("part") * (F.log(F.lit(every + 1.0) / (F.col("df") + 1)) + 1)).withColumn("key", F.round("score", 12))
    return _best(scored, k, F.desc("key")).select("blob_id", "packed", "cnt", "first_pos", "rank", "score")


def select_variance(counts: DataFrame, documents: int, k: int) -> DataFrame:
    """packed, variance: the k n-grams whose counts vary most over all blobs, absent counting as 0."""
    x = F.col("cnt").cast("double")
    own = counts.groupBy("packed").agg(F.sum(x).alias("a"), F.sum(x * x).alias("b"))
    variance = F.col("b") / documents - (F.col("a") / documents) * (F.col("a") / documents)
    return own.select("packed", F.round(variance, 9).alias("variance")).orderBy(F.desc("variance"), "packed").limit(k)
