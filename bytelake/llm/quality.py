"""Quality classifier: sizes under zstandard dictionaries of good and bad labelled text, calibrated to a score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Labelled documents of each class that the model is fitted on (those with the smallest hash of their id), by their
#: whole texts: half of them make the dictionaries, half the calibration.
TRAIN_DOCS = 2_000
CHUNK, DICTIONARY, LEVEL = 2_048, 65_536, 3
THRESHOLD = 0.7


def _chunks(raw: bytes) -> list[bytes]:
    """The whole text in chunks of CHUNK bytes, a short end joined to the last."""
    n = max(1, len(raw) // CHUNK)
    return [raw[i * CHUNK : (i + 1) * CHUNK if i < n - 1 else len(raw)] for i in range(n)]


class Difference:
    """The dealt quantity of a text: its size under the dictionary of bad text less that under the one of good text,
    by its length in bytes. 0 for a text without bytes."""

    def __init__(self, good: bytes, bad: bytes):
        dicts = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
        for d in dicts:
            d.precompute_compress(level=LEVEL)
        self.under = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False) for d in dicts]

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        good, bad = (sum(len(z.compress(p)) for p in _chunks(raw)) for z in self.under)
        return (bad - good) / len(raw)


def make_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of whole texts; of too little text to train on, the text itself."""
    parts = [p for t in texts for p in _chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY:] or b"empty dictionary"


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (bias first) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * len(x) * np.r_[0, w[1:]]
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.diag(np.r_[1e-9, np.ones(len(w) - 1)])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def held_out(doc_id, parts: int):
    """Whether crc32 of the id as text, modulo parts, is 2. A null id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, tuple]:
    """Dictionaries and calibration from labels (doc_id, quality) that aren't held out."""
    own = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out("doc_id", 4)).select("doc_id", "quality").withColumn("h", F.xxhash64("doc_id", F.lit("fit")))
    chosen = own.where("quality = 1").orderBy("h").limit(TRAIN_DOCS).unionByName(own.where("quality = 0").orderBy("h").limit(TRAIN_DOCS))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * TRAIN_DOCS rows
    rows = rows.select("h", F.col("quality").cast("int").alias("quality"), "text").where("text != ''")

    def train(tb: pa.Table) -> dict:
        texts = sorted(zip(tb.column("h").to_pylist(), (t.encode("utf-8", "surrogatepass") for t in tb.column("text").to_pylist()), strict=True))
        return {"quality": np.array([tb.column("quality")[0].as_py()], np.int32), "dictionary": np.array([make_dictionary([t for _, t in texts])], object)}

    half = rows.where("pmod(h, 2) = 0").select("quality", "h", "text")
    got = {r.quality: bytes(r.dictionary) for r in C.run_groups(half, ["quality"], train, "quality int, dictionary binary", ["quality", "dictionary"]).collect()}  # two rows
    dicts = [got.get(y) or make_dictionary([]) for y in (1, 0)]
    sent = docs.sparkSession.sparkContext.broadcast(dicts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = Difference(*sent.value)
        for rb in C.pieces(batches):
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([difference(t) for t in rb.column(2).to_pylist()], pa.float64())], ["h", "quality", "x"])

    rest = rows.where("pmod(h, 2) = 1").mapInArrow(measure, "h long, quality int, x double").collect()  # a number a row
    rest = sorted((r.h, r.quality, r.x) for r in rest) or [(0, 1, 0.0)]
    x, y = np.array([[r[2]] for r in rest]), np.array([r[1] for r in rest], float)
    return dicts[0], dicts[1], fit_logistic(x, y)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is the chance, 0 to 1, that the label is 1; predicted is 1 from 0.7 on. It depends on the text alone.
    Whole texts are compressed, in chunks, under a dictionary of good and one of bad text; the difference of the
    sizes, by the text's length, is calibrated by a logistic curve fitted on whole texts. Null and empty texts
    have no difference (0). Labels that are null or other than 0 and 1 are passed over, as are those whose
    crc32(doc_id) modulo 4 is 2. Without labels of a class the scores are near the other one. Repeated rows are
    scored each; null ids stay; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, (mean, scale, w) = model.value
        difference = Difference(good, bad)
        for rb in C.pieces(batches):
            texts = rb.column(2).to_pylist()
            x = np.array([[difference(t)] for t in texts])
            s = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[1:] + w[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(go, "doc_id long, held_out boolean, score double, predicted int")
