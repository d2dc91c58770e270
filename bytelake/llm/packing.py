"""Packing of token sequences into windows: combinations of lengths by non-negative least squares."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm import common as C

WINDOW = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of text remembered by a worker with their ids.
CACHE = 250_000
#: Documents of one length in a cell in which they are numbered.
CELL = 5_000

# The split of the byte-level vocabulary, and the characters that stand for its bytes.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _bytes_of() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoder(path: str):
    """(encode, added) of a tokenizer file: ids of ordinary text by the same vocabulary as ranks (equal ids, many times
    faster), and the ids of added tokens by their text."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)
    added = {x["content"]: x["id"] for x in vocab.get("added_tokens", [])}
    at = _bytes_of()
    ranks = {bytes(at[c] for c in word): i for word, i in vocab["model"]["vocab"].items() if word not in added}
    return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, added


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Ids(dict):
    """Ids, as little-endian 32-bit bytes, of a piece of text that begins at a single space (or a text's start)."""

    def __init__(self, encode, added: dict[str, int]):
        super().__init__()
        self.encode = encode
        self.added = {t: np.asarray([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(piece), "<u4").tobytes()
        if len(self) < CACHE and len(piece) < 64:
            self[piece] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a whole text. Added tokens in it are cut out first, as the tokenizer does; each part stands alone."""
        if not self.cut or not self.cut.search(text):
            return self.plain(text)
        return b"".join(self.added.get(part) or self.plain(part) for part in self.cut.split(text) if part)

    def plain(self, text: str) -> bytes:
        """The split never joins a letter, digit or sign to a space after it, so a text falls apart before each
        single space between two others than white space. Texts with other white space around spaces go whole."""
        if _RUNS.search(text) or text[:1] == " " or text[-1:] == " ":
            return np.asarray(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + x] for x in rest])


_RUNS = re.compile(r"\s\s")


def pieces_of(docs: DataFrame, vocabulary: str, window: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of each document and what is left."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(*load_encoder(vocabulary))
        end = np.uint32(END).tobytes()
        for rb in C.pieces(batches):
            doc, start, length, crc, tokens = [], [], [], [], []
            for k, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                raw = (ids.of(t) if t else b"") + end
                n = len(raw) // 4
                for a in range(0, n, window):
                    b = min(n, a + window)
                    doc.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    tokens.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, tokens)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(go, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that nearly minimises |a x - b|, by accelerated projected gradients."""
    x = y = np.zeros(a.shape[1])
    step, t = 1 / (np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf) + 1e-9), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def combinations(lengths: np.ndarray, window: int, slack: int) -> list[dict[int, int]]:
    """Shallow combinations of the lengths present whose sum is within slack below the window: k of one length,
    two lengths, and two of one with one of another. At most a few for each length."""
    there, found = set(lengths.tolist()), set()
    for a in lengths.tolist():
        if a * (window // a) >= window - slack and window // a <= 8:
            found.add(((a, window // a),))
        for times in (1, 2):
            for b in range(window - times * a, max(0, window - times * a - slack - 1), -1):
                if b in there and b != a:
                    found.add(tuple(sorted(((a, times), (b, 1)))))
                    break
    return [dict(c) for c in sorted(found)]


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = 16) -> list[tuple[dict[int, int], int]]:
    """(lengths with their numbers, repeats) of windows that hold every length as often as the histogram has it.

    Repeat counts of combinations come from non-negative least squares against the histogram, rounded down to
    what is left of their lengths; residuals are packed greedily, longest first, each window filled with the
    longest that still fits. All on counts by length, so its size doesn't grow with the number of documents.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = np.array(sorted(left), int)
    patterns: list[tuple[dict[int, int], int]] = []
    combos = combinations(lengths, window, slack)
    if combos:
        at = {n: i for i, n in enumerate(lengths.tolist())}
        a = np.zeros((len(lengths), len(combos)))
        for j, c in enumerate(combos):
            for n, k in c.items():
                a[at[n], j] = k
        x = nnls(a, np.array([left[n] for n in lengths.tolist()], float))
        for j in np.argsort(-x):
            times = min([int(x[j] + 1e-6), *(left[n] // k for n, k in combos[j].items())])
            if times > 0:
                patterns.append((combos[j], times))
                for n, k in combos[j].items():
                    left[n] -= k * times
    while any(left.values()):
        c, room = {}, window
        for n in sorted((n for n, k in left.items() if k), reverse=True):
            if k := min(left[n], room // n):
                c[n] = k
                room -= n * k
        times = min(left[n] // k for n, k in c.items())
        patterns.append((c, times))
        for n, k in c.items():
            left[n] -= k * times
    return patterns


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, number a sequence and first offset of each pattern with it."""
    found: dict[int, list] = {}
    seq = 0
    for c, times in patterns:
        offset = 0
        for n, k in c.items():
            rows = found.setdefault(n, [])
            rows.append((rows[-1][0] + rows[-1][2] * rows[-1][4] if rows else 0, seq, k, offset, times))
            offset += n * k
        seq += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in found.items()}


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids (null text: none) and the end id. It is cut into full windows, each a sequence of its
    own, and a rest; rests are packed whole into sequences of at most `window` ids. Every id lies in one piece,
    offsets in a sequence have no gaps, sequence ids count from 0. Repeated rows and null ids are documents like
    others; an empty table gives no rows; other columns are ignored.

    The histogram of rest lengths has at most `window` entries, so the plan made from it is small whatever the
    corpus; it alone reaches the driver. Each rest then gets its rank among those of its length, counted in cells
    of bounded size, and looks its place up in the plan. No ids are kept or shuffled. Added tokens of the tokenizer
    file are single ids, as there.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    pieces = C.materialize(pieces_of(base, vocabulary or tokenizer_path(), window))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    full = counts.pop(window, 0)
    slots = spark.sparkContext.broadcast(_slots(plan(counts, window)))
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    cells = F.array(*[F.lit(1 + c // CELL) for c in [0, *(({window: full} | counts).get(n, 0) for n in range(1, window + 1))]])
    pieces = C.materialize(pieces.withColumn("cell", F.pmod(F.xxhash64("row"), F.get(cells, F.col("length").cast("int"))).cast("int")))
    sizes = pieces.groupBy("length", "cell").agg(F.count("*").alias("c"))  # a row for 5,000 pieces or a length
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("length", "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1
    ranked = pieces.withColumn("rank", rank).join(ahead, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n, rank = rb.column("length").to_numpy(), rb.column("rank").to_numpy()
            seq, off = rank.copy(), np.zeros(len(n), np.int64)
            seq[n < window] += full
            for length in np.unique(n[n < window]):
                first, start, k, offset, _ = slots.value[int(length)]
                own = np.flatnonzero(n == length)
                i = np.searchsorted(first, rank[own], side="right") - 1
                d = rank[own] - first[i]
                seq[own] = full + start[i] + d // k[i]
                off[own] = offset[i] + d % k[i] * length
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
