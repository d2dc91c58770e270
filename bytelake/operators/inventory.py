"""What a corpus holds: sizes, extensions, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.sources import ok_ext


def large_files(files: DataFrame, min_bytes: int = 1 << 20) -> DataFrame:
    """Files larger than min_bytes, smallest first, with their size in MiB to three decimals."""
    big = files.where(F.col("length") > min_bytes)
    return big.select("path", "length", F.format_string("%.3f", F.col("length") / F.lit(float(1 << 20))).alias("mib")).orderBy("length", "path")


def extension_inventory(files: DataFrame) -> DataFrame:
    """Extensions, as written, of acceptable files, with the number of files."""
    ext = F.regexp_extract("path", r".*\.(\S+)$", 1)
    return files.where(ok_ext("name")).select(ext.alias("extension")).where("extension != ''").groupBy("extension").agg(F.count("*").alias("files"))


def corpus_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"))


def sample_per_class(blobs: DataFrame, k: int = 1, most: int = 5, seed: int = 0) -> DataFrame:
    """k blobs, drawn by a hash of id and seed, of each of the first `most` classes. Content isn't shuffled."""
    h, cell = F.xxhash64(F.lit(seed), "blob_id"), F.pmod(F.xxhash64("blob_id"), F.lit(1024))
    rows = blobs.where("label IS NOT NULL").select("blob_id", "label", h.alias("h"), cell.alias("cell"))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h", "blob_id"))
    some = rows.withColumn("r", first("label", "cell")).where(F.col("r") <= k)  # k of each cell, then k of these
    ids = some.withColumn("r", first("label")).where(F.col("r") <= k).select("blob_id", "label")
    classes = ids.select("label").distinct().orderBy("label").limit(most)
    ids = ids.join(F.broadcast(classes), "label", "left_semi").select("blob_id")  # at most k * most ids
    return blobs.join(F.broadcast(ids), "blob_id", "left_semi")
