"""Byte statistics of blobs: histogram, entropy, windows, lengths, bigrams and corpus-wide transitions.

One helper reads each blob once and gives its numbers as arrays; what follows is built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.operators.grams import CHUNK, ROWS, content_of, counted, gram_counts

# The sizes, in KiB, that lengths are measured against.
LENGTHS_K = (1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits a byte of rows of counts; 0 for a row without bytes."""
    total = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(total, 1)
    return -np.sum(p * np.log2(np.where(p > 0, p, 1)), -1) + 0.0


def byte_histogram(b: np.ndarray) -> np.ndarray:
    """How often each of the 256 bytes occurs, a chunk at a time."""
    return sum((np.bincount(b[i : i + CHUNK], minlength=256) for i in range(0, len(b), CHUNK)), np.zeros(256, np.int64))


def window_entropies(b: np.ndarray, window: int) -> np.ndarray:
    """Entropies of windows from the start; the last counts if it has half a window or more. Some windows at a time."""
    full = len(b) // window
    n = full + (0 < len(b) - full * window >= window / 2)
    step, out = max(1, CHUNK // window), [np.empty(0)]
    share = np.arange(window + 1) / window
    term = share * np.log2(np.where(share > 0, share, 1))  # of each count of a byte in a whole window
    for i in range(0, n, step):
        k, whole = min(step, n - i), max(0, min(step, full - i))
        some = b[i * window : (i + k) * window].astype(np.int64)
        some += np.arange(len(some)) // window << 8
        counts = np.bincount(some, minlength=k * 256).reshape(k, 256)
        out.append(-np.sum(term[counts[:whole]], -1) + 0.0)
        if whole < k:
            out.append(entropy(counts[whole:]))
    return np.concatenate(out)


def byte_counts(blobs: DataFrame) -> DataFrame:
    """blob_id, byte, cnt: bytes that occur."""
    return gram_counts(blobs, 1).select("blob_id", F.col("packed").cast("int").alias("byte"), "cnt")


def histogram(blobs: DataFrame, nonfinite: str = "keep") -> DataFrame:
    """256 features b_0 .. b_255 of each blob, the share of each byte; zeros are there. An empty blob has NaN, or
    with nonfinite="drop" no rows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            counts = [byte_histogram(b) for b in content_of(rb)]
            flat = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 256, dtype=np.int32), flat.astype(np.int64))], ["blob_id", "counts"])

    rows = blobs.select("blob_id", "content").mapInArrow(go, "blob_id string, counts array<bigint>")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("total", total)
    if nonfinite == "drop":
        rows = rows.where("total > 0")
    share = F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(float("nan"))
    return rows.select("blob_id", "total", F.posexplode_outer("counts").alias("emit_idx", "c")).select("blob_id", "emit_idx", F.concat(F.lit("b_"), "emit_idx").alias("feature"), share.alias("value"))


def byte_shares(b: np.ndarray) -> np.ndarray:
    """The values of histogram for one blob."""
    return byte_histogram(b) / len(b) if len(b) else np.full(256, np.nan)


def byte_share_values(b: np.ndarray) -> tuple[list[str], list[float]]:
    """Names and values of histogram for one blob."""
    return list(BYTE_NAMES), byte_shares(b).tolist()


BYTE_NAMES = tuple(f"b_{i}" for i in range(256))
histogram.values = byte_share_values
histogram.fixed = (BYTE_NAMES, byte_shares)
histogram.prefixes = ("b_",)


#: From the bytes of a blob, names and values of its features.
Values = Callable[[np.ndarray], tuple[list[str], list[float]]]


#: Names of features that every blob has in that order, and their values from the bytes of a blob.
Fixed = tuple[tuple[str, ...], Callable[[np.ndarray], np.ndarray]]


def feature_rows(blobs: DataFrame, extractors: list[tuple[int, Values]], last: bool = False, more: str | None = None, fixed: list[tuple[int, Fixed]] = ()) -> DataFrame:
    """blob_id, extractor_idx, emit_idx, feature, value of all extractors (index, function of a blob's bytes), in one pass
    over content. A column `more` holds arrays of such rows, which join them. With last, of each blob's rows of one name
    only the one emitted last. Those of fixed (index, names and function) have names that no other row has, and are sent
    back apart, without a Python object a row."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
    columns = ["blob_id", "extractor_idx", "emit_idx", "feature", "value"]

    def sent(rb: pa.RecordBatch, held: list[list]) -> pa.RecordBatch:
        place, *cols = (pa.array(c, kind) for c, kind in zip(held, kinds, strict=True))
        return pa.RecordBatch.from_arrays([rb.column(0).take(place), *cols], columns)

    def plain(rb: pa.RecordBatch, start: int, values: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (x, (names, _)), found in zip(fixed, values, strict=True):
            k, n = len(found), len(names)
            emit = np.tile(np.arange(n, dtype=np.int32), k)
            cols = [np.full(k * n, x, np.int32), emit, pa.array(names).take(pa.array(emit)), np.concatenate(found).astype(float)]
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(np.repeat(np.arange(start, start + k), n))), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], columns)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROWS // max((len(names) for _, (names, _) in fixed), default=1))
        for rb in batches:
            held, values, start = [[] for _ in kinds], [[] for _ in fixed], 0
            if more:
                at = rb.column(2).offsets.to_numpy() - rb.column(2).offsets[0].as_py()
                flat = rb.column(2).flatten()
                given = list(zip(*(flat.field(c).to_pylist() for c in ("extractor_idx", "emit_idx", "feature", "value")), strict=True))
            for i, b in enumerate(content_of(rb)):
                for own, (_, (_, f)) in zip(values, fixed, strict=True):
                    own.append(f(b))
                xs, emits, names, found = [], [], [], []
                for x, f in extractors:
                    name, value = f(b)
                    xs += [x] * len(name)
                    emits += range(len(name))
                    names += name
                    found += value
                if more and at[i] < at[i + 1]:
                    rows = sorted([*zip(xs, emits, names, found, strict=True), *given[at[i] : at[i + 1]]], key=lambda r: r[:2])
                    xs, emits, names, found = (list(c) for c in zip(*rows, strict=True))
                if last and len(set(names)) < len(names):
                    stay = list({name: j for j, name in enumerate(names)}.values())
                    xs, emits, names, found = ([c[j] for j in stay] for c in (xs, emits, names, found))
                for col, c in zip(held, ([i] * len(names), xs, emits, names, found), strict=True):
                    col += c
                if held[0] and (len(held[0]) >= ROWS or i + 1 == rb.num_rows):
                    yield sent(rb, held)
                    held = [[] for _ in kinds]
                if fixed and (i + 1 - start >= step or i + 1 == rb.num_rows):
                    yield from plain(rb, start, values)
                    values, start = [[] for _ in fixed], i + 1

    return blobs.select("blob_id", "content", *([more] if more else [])).mapInArrow(go, "blob_id string, extractor_idx int, emit_idx int, feature string, value double")


def entropy_values(b: np.ndarray, window: int = 256) -> tuple[list[str], list[float]]:
    """Names and values of entropy_features for one blob."""
    w = window_entropies(b, window)
    rest = [float(x) for x in ((w.min(), w.max(), w.mean(), w.std()) if len(w) else (np.inf, -np.inf, np.nan, np.nan))]
    return ["global_entropy", *(f"{x}_window_entropy" for x in ("min", "max", "mean", "std"))], [float(entropy(byte_histogram(b))), *rest]


def entropy_features(blobs: DataFrame, window: int = 256, nonfinite: str = "keep") -> DataFrame:
    """global_entropy and min, max, mean and population deviation of the windows' entropies. Without a window these
    are +Infinity, -Infinity, NaN and NaN, or with nonfinite="drop" absent."""
    rows = feature_rows(blobs, [(0, lambda b: entropy_values(b, window))]).drop("extractor_idx")
    return rows.where(~F.isnan("value") & (F.abs("value") != float("inf"))) if nonfinite == "drop" else rows


entropy_features.values = entropy_values
entropy_features.prefixes = ("global_entropy", "min_window", "max_window", "mean_window", "std_window")


def length_array(blobs: DataFrame, name: str) -> DataFrame:
    """blobs with an array column of the rows (emit_idx, feature, value) of length_features."""
    part = lambda k: F.sqrt(F.least(F.col("length"), F.lit(k * 1024)) / F.lit(k * 1024.0))
    return blobs.withColumn(name, F.array(*[F.struct(F.lit(i).alias("emit_idx"), F.lit(f"root_length_{k}k").alias("feature"), part(k).alias("value")) for i, k in enumerate(LENGTHS_K)]))


def length_features(blobs: DataFrame) -> DataFrame:
    """root_length_<k>k: square root of the length by k KiB, 1 at most."""
    return length_array(blobs, "_rows").select("blob_id", F.inline_outer("_rows"))


length_features.array = length_array
length_features.prefixes = ("root_length_",)


def bigram_counts(blobs: DataFrame) -> DataFrame:
    """blob_id, first, second, cnt of adjacent byte pairs."""
    return gram_counts(blobs, 2).select("blob_id", F.shiftright("packed", 8).cast("int").alias("first"), F.col("packed").bitwiseAND(F.lit(255)).cast("int").alias("second"), "cnt")


def bigram_range(blobs: DataFrame) -> DataFrame:
    """max_count, min_count and ref_min (1: the least of running counts) of blobs with a pair."""
    return bigram_counts(blobs).groupBy("blob_id").agg(F.max("cnt").alias("max_count"), F.min("cnt").alias("min_count"), F.lit(1).cast("long").alias("ref_min"))


def bigram_grid(blobs: DataFrame) -> DataFrame:
    """All 65,536 pairs of each blob, zeros too: a table of a blob's counts from the helper, taken apart where it is. No
    join."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, b in enumerate(content_of(rb)):
                grid = np.zeros(1 << 16, np.int64)
                u, c, _ = counted(b, 2)
                grid[u] = c
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(grid)], pa.int32()), pa.array(grid))], ["blob_id", "counts"])

    rows = blobs.select("blob_id", "content").mapInArrow(go, "blob_id string, counts array<bigint>").select("blob_id", F.posexplode("counts").alias("cell", "cnt"))
    return rows.select("blob_id", F.shiftright("cell", 8).alias("first"), F.col("cell").bitwiseAND(F.lit(255)).alias("second"), "cnt")


def bigram_intensity(blobs: DataFrame) -> DataFrame:
    """Brightness round(255 * (count / largest) ** (1 / 4)) of each pair that occurs."""
    top = F.max("cnt").over(Window.partitionBy("blob_id"))
    return bigram_counts(blobs).select("blob_id", "first", "second", F.floor(255 * F.pow(F.col("cnt") / top, F.lit(0.25)) + 0.5).cast("long").alias("intensity"))


def bigram_values(b: np.ndarray, top: int = 16) -> tuple[list[str], list[float]]:
    """Names and values of bigram_features for one blob."""
    u, c, _ = counted(b, 2)
    if not len(u):
        return [], []
    best = np.lexsort((u, -c))[:top]
    total = float(c[best].sum())
    names, values = ["bigram_total_count"], [total]
    for g, n in zip(u[best].tolist(), c[best].tolist(), strict=True):
        key = f"bigram_{g >> 8:02x}_{g & 255:02x}"
        names += [key, f"{key}_norm"]
        values += [float(n), n / total]
    return [*names, "bigram_unique_count", "bigram_distribution"], [*values, float(len(u)), float((c.astype(float) ** 2).sum() / (total * total))]


def bigram_features(blobs: DataFrame, top: int = 16) -> DataFrame:
    """bigram_total_count (of the top pairs only), bigram_xx_yy and its _norm for each of them, bigram_unique_count
    and bigram_distribution (over all pairs, by that total). Blobs without a pair have none. No shuffle."""
    return feature_rows(blobs, [(0, lambda b: bigram_values(b, top))]).drop("extractor_idx")


bigram_features.values = bigram_values
bigram_features.prefixes = ("bigram_",)


def corpus_markov(blobs: DataFrame, name: str | None = None) -> DataFrame:
    """kind (start, stop or pair), first, second, cnt over all blobs; empty blobs are passed over. For starts and
    stops second is null. With a name such as ".prg", over blobs whose name contains it alone, so that content of
    others isn't read."""
    blobs = blobs if name is None else blobs.where(F.contains("name", F.lit(name)))
    ends = blobs.where("length > 0").select(F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.conv(F.hex(F.substring("content", 1, 1)), 16, 10).cast("int").alias("first")), F.struct(F.lit("stop").alias("kind"), F.conv(F.hex(F.substring("content", -1, 1)), 16, 10).cast("int").alias("first")))).alias("e"))
    ends = ends.groupBy("e.kind", "e.first").agg(F.count("*").alias("cnt")).select("kind", "first", F.lit(None).cast("int").alias("second"), "cnt")
    pairs = bigram_counts(blobs).groupBy("first", "second").agg(F.sum("cnt").alias("cnt")).select(F.lit("pair").alias("kind"), "first", "second", "cnt")
    return ends.unionByName(pairs)


def save_markov(counts: DataFrame, root: str) -> None:
    """The 258 rows of markov_matrix as lines of 256 numbers and commas, one file, in order."""
    markov_matrix(counts).select("row", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("line")).coalesce(1).sortWithinPartitions("row").select("line").write.mode("overwrite").text(root)


def markov_matrix(counts: DataFrame) -> DataFrame:
    """258 rows of 256 counts: starts, a row for each first byte, stops."""
    row = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "stop", 257).otherwise(F.col("first") + 1)
    cell = F.when(F.col("kind") == "pair", F.col("second")).otherwise(F.col("first"))
    own = counts.select(row.alias("row"), cell.alias("cell"), "cnt").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("cell", "cnt"))).alias("m"))
    rows = counts.sparkSession.range(258).select(F.col("id").cast("int").alias("row"))
    at = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return rows.join(own, "row", "left").select("row", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0).cast("long"), 256)).otherwise(at).alias("counts")).orderBy("row")
