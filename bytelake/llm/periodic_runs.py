"""Periodic runs of words (one phrase repeated without a break), by block convolution at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Repetitions and words that a run has at least.
REPEATS, LEAST = 4, 6
#: Values transformed at once (one block and its window at least), and words of texts that are worked on together.
TRANSFORMED, TOGETHER = 1 << 18, 1 << 17
#: Modulus of the transforms, 15 * 2**27 + 1: products of two residues fit 64 bits, and lengths up to 2**27 have roots.
PRIME, GENERATOR = 2013265921, 31

_P = np.uint64(PRIME)
_roots: dict[int, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n/2 powers of a root of unity of order n."""
    key = -n if inverse else n
    if key not in _roots:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        step, out = pow(root, PRIME - 2, PRIME) if inverse else root, np.ones(1, np.uint64)
        while len(out) < n // 2:
            out = np.concatenate([out, out * np.uint64(pow(step, len(out), PRIME)) % _P])
        if n > TRANSFORMED:
            return out
        _roots[key] = out
    return _roots[key]


def ntt(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (residues; a power of two of them). Forward leaves its values in
    bit-reversed order, which inverse takes and puts right, without the division by the length."""
    n, rows = x.shape[1], x.shape[0]
    for h in [1 << k for k in range((n - 1).bit_length())] if inverse else [n >> k for k in range(1, n.bit_length())]:
        y = x.reshape(rows, n // (2 * h), 2, h)
        a, b, w = y[:, :, 0], y[:, :, 1], _powers(2 * h, inverse)
        out = np.empty_like(y)
        if inverse:
            t = b * w % _P
            out[:, :, 0], out[:, :, 1] = a + t, a + (_P - t)
            out = np.where(out >= _P, out - _P, out)
        else:
            s = a + b
            out[:, :, 0] = np.where(s >= _P, s - _P, s)
            out[:, :, 1] = (a + (_P - b)) * w % _P
        x = out.reshape(rows, n)
    return x


def zero_mismatches(x: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all blocks x[start : start + size] that stand again at a distance of size to 2 size - 1.

    The squared differences of a block and each of the size places in the window that follows it sum to the block's
    squares, and the place's squares, less twice their products; all products come from one transform a block, exact
    modulo PRIME. A sum that only is a multiple of PRIME passes too: what is found are seeds, which are compared later.
    """
    found = []
    step = max(1, TRANSFORMED // (2 * size))
    for i in range(0, len(starts), step):
        b = starts[i : i + step]
        at = b[:, None] + np.arange(3 * size)
        v = np.where(at < len(x), x[np.minimum(at, len(x) - 1)], PRIME - 1).astype(np.uint64)
        block, window = np.zeros((len(b), 2 * size), np.uint64), v[:, size:]
        block[:, 0] = v[:, 0]
        block[:, : size : -1] = v[:, 1:size]  # turned round, so that the product is a correlation
        products = ntt(ntt(block) * ntt(window) % _P, inverse=True)[:, :size]
        products = products * np.uint64(pow(2 * size, PRIME - 2, PRIME)) % _P
        squares = v * v % _P
        total = np.concatenate([np.zeros((len(b), 1), np.uint64), np.cumsum(squares, 1)], 1)  # below 2**31 times the length
        places = total[:, size + np.arange(size) + size] - total[:, size + np.arange(size)]
        own = total[:, size] % _P
        r, s = np.nonzero((own[:, None] + places % _P + 2 * (_P - products)) % _P == 0)
        found.append((b[r], s + size))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as numbers of its words from 0, all runs (start, length, period) by start, then period.

    A run is a stretch of words that has smallest period q (words q apart are the same), REPEATS * q words and LEAST
    words at least, and that no neighbouring word extends with period q.

    At each scale B = 1, 2, 4, ... the texts are cut to blocks of B words. A run of a period from B to 2B - 1 holds a
    whole block and that block again one period on, since 2B - 1 + q <= 4q. So all blocks with a place of zero mismatch
    in the window behind them are seeds, and their distance is a period to try: words at that distance are compared to
    both sides, as far as they agree. Blocks with a word that the text holds less than REPEATS times are in no run.
    Blocks whose window lies in a run of a smaller period add nothing: distances there are its multiples.
    """
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    kinds = [int(t.max()) + 1 if len(t) else 0 for t in texts]
    # One word of its own ends each text.
    x = np.concatenate([np.append(t, k) for t, k in zip(texts, kinds, strict=True)]).astype(np.int64) if texts else np.empty(0, np.int64)
    often = np.concatenate([np.append((np.bincount(t, minlength=k) >= REPEATS)[t], False) for t, k in zip(texts, kinds, strict=True)]) if texts else np.empty(0, bool)
    rare = np.concatenate([[0], np.cumsum(~often)])
    runs: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    left, right = np.empty(0, np.int64), np.empty(0, np.int64)  # ends of the runs found at smaller scales
    size, longest = 1, max(map(len, texts), default=0)
    while REPEATS * size <= longest:
        b = np.arange(0, len(x) - size + 1, size)
        b = b[rare[b + size] == rare[b]]
        if len(left):
            reach = right[np.searchsorted(left, b, "right") - 1]  # of the runs that begin before b, the furthest end
            b = b[~((np.searchsorted(left, b, "right") > 0) & (reach >= b + 3 * size))]
        seed, distance = zero_mismatches(x, b, size)
        doc = np.searchsorted(starts, seed, "right") - 1
        same = seed + distance + size < starts[doc + 1]  # numbers of words are a text's own
        seed, distance, doc = seed[same], distance[same], doc[same]
        order = np.lexsort((seed, distance, doc))
        seed, distance, doc = seed[order], distance[order], doc[order]
        cuts = np.append(np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(distance, prepend=-1)), len(seed))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            d, s = int(doc[i]), int(distance[i])
            t = texts[d]
            if REPEATS * s > len(t):
                continue
            edges = np.concatenate([[-1], np.flatnonzero(t[:-s] != t[s:]), [len(t) - s]])
            for e in np.unique(np.searchsorted(edges, seed[i:j] - starts[d], "right") - 1):
                span = (int(edges[e]) + 1, int(edges[e + 1]) + s)
                if span[1] - span[0] >= max(LEAST, REPEATS * s) and span not in runs[d]:
                    runs[d][span] = s
        ends = np.array([(starts[d] + a, starts[d] + z) for d, own in enumerate(runs) for a, z in own], np.int64).reshape(-1, 2)
        ends = ends[np.argsort(ends[:, 0], kind="stable")]
        left, right = ends[:, 0], np.maximum.accumulate(ends[:, 1]) if len(ends) else ends[:, 1]
        size *= 2
    return [sorted((a, z - a, q) for (a, z), q in own.items()) for own in runs]


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words long, runs array of (start, length, period) and collapsed string, in place of columns of those names.

    Words are runs of bytes other than space and \\t to \\r, compared as they are; null counts as no words. Runs are
    those of find_runs, by start, then period. collapsed holds the words, joined by one space, without those that a run
    contains after its first `period` words; it is empty where no word is.

    A text is worked on whole, where it is read, however long; nothing is shuffled. Rows are taken each for itself:
    nulls in other columns, repeated rows and rows of one id stay as they are. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    at = kept.index(text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        for rb in C.pieces(batches):
            texts = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in rb.column(at).to_pylist()]
            found: list[list[tuple[int, int, int]]] = []
            held: list[np.ndarray] = []
            for i, words in enumerate(texts):
                held.append(_numbers(words))
                if i + 1 == len(texts) or sum(map(len, held)) + len(texts[i + 1]) > TOGETHER:
                    found += find_runs(held)
                    held = []
            out = []
            for words, runs in zip(texts, found, strict=True):
                if runs:
                    keep = np.ones(len(words), bool)
                    for a, n, q in runs:
                        keep[a + q : a + n] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([len(w) for w in texts], pa.int64()), runs, pa.array(out, pa.string())], [*kept, "n_words", "runs", "collapsed"])

    shown = docs.select(*(F.col(c) for c in kept))
    schema = shown.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast("array<struct<start:long,length:long,period:long>>"), "collapsed": F.lit("")}).schema
    return shown.mapInArrow(go, schema)


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text of a document whose crc32(doc_id) ends in 0: from word a = g mod n on, g the crc32 div 10, words repeat
    with period p = 1 + (n - a) div (3 + g mod 8). Other texts, those without words and those with a null id stay."""
    h = F.crc32(doc_id.cast("string"))
    w = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    named = F.struct(w.alias("w"), F.size(w).cast("long").alias("n"), F.floor(h / 10).alias("g"))
    named = F.transform(F.array(named), lambda s: s.withField("a", F.when(s["n"] > 0, s["g"] % s["n"])))
    named = F.transform(named, lambda s: s.withField("p", F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8)) + 1))
    done = F.transform(named, lambda s: F.transform(s["w"], lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))
    return F.when(doc_id.isNotNull() & (h % 10 == 0) & (F.size(w) > 0), F.array_join(F.get(done, F.lit(0)), " ")).otherwise(text)


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest
    start, then period; null without a run), runs_sha256 and collapsed_sha256, by periodic_runs over with_repeats.

    A null id isn't repeated in; repeated rows come back repeated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), with_repeats(F.col("doc_id"), F.col("text").cast("string")).alias("text"))
    found = periodic_runs(rows)
    first = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("first", first)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("first.s").alias("start"),
        (-F.col("first.l")).alias("length"),
        F.col("first.p").alias("period"),
        F.floor(-1000 * F.col("first.l") / F.col("first.p")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
