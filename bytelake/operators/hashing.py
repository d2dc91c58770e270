"""Hashes of content, lookup by hash and groups of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALGORITHMS = ("sha1", "md5", "crc32")
#: Names in a row of an answer.
NAMES = 10_000

# What an answer of the corpus is tagged with.
TAG, AUTHORITY = "corpus", "syscorpus"


def content_hashes(blobs: DataFrame) -> DataFrame:
    """name, sha1, md5 and crc32 of the content, in lower-case hex."""
    crc = F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0")
    return blobs.select("name", F.sha1("content").alias("sha1"), F.md5("content").alias("md5"), crc.alias("crc32"))


def hash_table(blobs: DataFrame, algorithms: tuple[str, ...] = ALGORITHMS, *keep: str) -> DataFrame:
    """name, columns to keep, algo, hash: a row for each algorithm; only those are computed."""
    crc = F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0")
    of = {"sha1": F.sha1("content"), "md5": F.md5("content"), "crc32": crc}
    pairs = F.array(*(F.struct(F.lit(a).alias("algo"), of[a].alias("hash")) for a in algorithms))
    return blobs.select("name", *keep, F.inline(pairs))


def find_by_hash(hashes: DataFrame, algo: str, requests: DataFrame, most: int = NAMES) -> DataFrame:
    """hash, chunk, chunks, copies, names, tags, authority: for each distinct requested hash the names with it (none is an
    empty list), sorted, in rows of about `most` names: a hash with n names has ceil(n / most) rows, to which names are
    dealt by their own hash, so that no task gets all of them. An unknown algorithm is an error; null requests are passed
    over."""
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown hash algorithm: {algo}")
    asked = requests.select(F.lower("hash").alias("hash")).where("hash IS NOT NULL").distinct()
    own = hashes.where(F.col("algo") == algo).select("hash", "name").join(asked, "hash", "left_semi")
    counts = own.groupBy("hash").agg(F.count("*").alias("copies"))
    sized = asked.join(counts, "hash", "left").na.fill({"copies": 0}).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("copies") / most)).cast("int"))
    cell = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    dealt = own.join(sized.where("copies > 0"), "hash").groupBy("hash", cell.alias("chunk")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    rows = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = rows.join(dealt, ["hash", "chunk"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return found.select("hash", "chunk", "chunks", "copies", "names", F.array(F.lit(TAG)).alias("tags"), F.struct(F.lit(AUTHORITY).alias("id")).alias("authority"))


def duplicate_groups(hashes: DataFrame, algo: str = "sha1") -> DataFrame:
    """hash, copies, name: a row for each name whose content others share, so that a very common content is no one row."""
    own = hashes.where(F.col("algo") == algo).select("hash", "name")
    shared = own.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return own.join(shared, "hash").select("hash", "copies", "name")
