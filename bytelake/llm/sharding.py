"""Sharding into shards of nearly equal bytes by sampled splitters. DataFrame functions only."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Bytes that a record takes besides its text.
RECORD = 16
#: Rows aimed at in one range, and the most ranges (which bounds the sample and the splitters).
RANGE_ROWS = 20_000
MAX_RANGES = 65_536
#: Sampled keys for each range.
DRAWS = 16
_LOW = -(1 << 63)


def _position(h: Column, k: Column, splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters (h, k) at or below a key: a binary search in two literal arrays."""
    if not splitters:
        return F.lit(0)
    hs, ks = (F.lit(np.array(x, np.int64)) for x in zip(*splitters, strict=True))
    steps = F.array(*[F.lit(1 << i) for i in range(len(splitters).bit_length() - 1, -1, -1)])

    def step(at: Column, by: Column) -> Column:
        to = at + by
        sh, sk = F.get(hs, to - 1), F.get(ks, to - 1)
        return F.when((to <= len(splitters)) & ((sh < h) | ((sh == h) & (sk <= k))), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: shards are runs of equal length, in bytes, of all records in the order of (hash of the
    text, doc_id), so shard sizes differ by no more than a record or so, and equal texts lie together except
    where a run ends inside their group. size is the text's UTF-8 bytes (null: none) plus 16, text_crc32 the
    CRC of those bytes (null: of none), slot counts from 0 without gaps in each shard, grown_shard is null.
    Null ids sort first; repeated rows are records of their own; an empty table gives no rows; other columns
    are ignored.

    A size-weighted sample of keys gives quantile boundaries; records are dealt to the ranges between them.
    Ranges with more than four times the rows meant for one (very many small records, or one key repeated) are
    subdivided by a hash. Running sums are then taken inside each range, and the totals of the ranges, of which
    there is a bounded number, give each range its place. No text is shuffled.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(t) + RECORD).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("h"),
    )
    rows, seen = C.materialize(rows, F.count("*").alias("n"), F.sum("size").alias("bytes"))
    n, total = seen["n"], seen["bytes"] or 1
    ranges = min(MAX_RANGES, max(4 * shards, math.ceil(n / RANGE_ROWS)))
    key = F.coalesce("doc_id", F.lit(_LOW))
    chance = F.col("size") * (DRAWS * ranges / total)
    draw = F.pmod(F.xxhash64(F.lit("draw"), "h", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = sorted({(r.h, r.k) for r in rows.where(draw < chance).select("h", key.alias("k")).toLocalIterator()})
    splitters = sample[DRAWS - 1 :: DRAWS]

    dealt = rows.withColumn("range", _position(F.col("h"), key, splitters))
    most = 4 * max(1, n / (len(splitters) + 1))
    parts = [1] * (len(splitters) + 1)
    for r in dealt.groupBy("range").count().where(F.col("count") > most).toLocalIterator():
        parts[r["range"]] = math.ceil(2 * r["count"] / most)
    sub = F.pmod(F.xxhash64(F.lit("part"), F.monotonically_increasing_id()), F.get(F.lit(np.array(parts, np.int64)), F.col("range")))
    dealt = C.materialize(dealt.withColumn("part", sub))

    cells = sorted(tuple(r) for r in dealt.groupBy("range", "part").agg(F.sum("size"), F.count("*")).toLocalIterator())
    start, before, at = [], 0, 0
    for r, p, size, count in cells:
        start.append((r, p, before, at))
        before, at = before + size, at + count
    start = spark.createDataFrame(start, "range int, part long, bytes_before long, rows_before long")
    run = Window.partitionBy("range", "part").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    placed = dealt.withColumns({"upto": F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(run) - 1})
    placed = placed.join(F.broadcast(start), ["range", "part"])  # no more rows than twice the ranges
    middle = F.expr("2 * (bytes_before + upto) - size")  # twice the place of the record's middle
    shard = F.least(F.lit(shards - 1), F.floor(middle / F.lit(2.0) * (shards / total))).cast("int")
    placed = C.materialize(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rank") + F.col("rows_before")).alias("rank")))
    first = {r["shard"]: r["rank"] for r in placed.groupBy("shard").agg(F.min("rank").alias("rank")).toLocalIterator()}
    first = [first.get(s, 0) for s in range(shards)]
    assert all(a <= b or not b for a, b in pairwise(first))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.get(F.lit(np.array(first, np.int64)), F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
