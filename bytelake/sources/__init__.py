"""Reading and writing corpora, hashes, features and models."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.operators.hashing import ALGORITHMS

#: Bytes and rows of archives' entries that are sent back at once.
SENT_BYTES, SENT_ROWS = 1 << 23, 10_000
BLOBS = "blob_id string, name string, path string, length long, content binary, label string"

# Extensions and names of files that aren't taken for binaries of the corpus.
DENIED = (
    "tap TAP sqlite brd img bin com exe diz pdf xlsm xlsx pptx doc jpg wav webm png gif mid ico txt md readme log nfo "
    "bat sh c cpp h asm s i o pl inc a65 s65 lst mk svg css rb html htm js Makefile yml xml vkm sln vcxproj "
    "vcxproj.filters vcxproj.user zip ZIP tar lha hqx tgz gz"
).split()


def ok_ext(name: Column | str, denied=DENIED) -> Column:
    """False where the name is a denied one, or ends, in any case, with a dot and a denied extension. Null is false."""
    n = F.col(name) if isinstance(name, str) else name
    suffixes = "|".join(sorted({d.lower().replace(".", r"\.") for d in denied}))
    return F.coalesce(~n.isin(*denied) & ~F.lower(n).rlike(rf"(?s)\.({suffixes})$"), F.lit(False))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All files below root: name, path, length, content. Names that begin with . or _ are skipped, as are files
    that can't be read and, by Spark's reader, empty ones. Content is read only by queries that use it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "content")


def filter_corpus(files: DataFrame, min_size: int = 0, max_size: int = 65536, name: str = "name", length: str = "length") -> DataFrame:
    """Files with min_size < length < max_size and an acceptable extension."""
    return files.where((F.col(length) > min_size) & (F.col(length) < max_size) & ok_ext(name))


def read_labelled(spark: SparkSession, root: str, dedupe_ids: bool = False) -> DataFrame:
    """Blob table of files below root, labelled by their first directory. blob_id is the path; with dedupe_ids it is
    label_name, and of several files with one id the last by path stays."""
    top = root.rstrip("/").removeprefix("file:").rstrip("/").replace("\\", "/")
    files = scan_corpus(spark, root)
    label = F.regexp_extract("path", "^.*?" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in top) + "/([^/]+)/", 1)
    blobs = files.select(F.col("path").alias("blob_id"), "name", "path", "length", "content", label.alias("label")).where("label != ''")
    if not dedupe_ids:
        return blobs
    ids = blobs.groupBy(F.concat_ws("_", "label", "name").alias("id")).agg(F.max("path").alias("last"))  # paths only
    kept = blobs.join(ids.select("id", F.col("last").alias("path")), "path")
    return kept.select(F.col("id").alias("blob_id"), "name", "path", "length", "content", "label")


def blobs_from_column(df: DataFrame, id_col: str, content_col: str, label_col: str | None = None, name_col: str | None = None) -> DataFrame:
    """Blob table from a bytes or text column (as UTF-8); null content is empty."""
    content = F.col(content_col) if dict(df.dtypes)[content_col] == "binary" else F.encode(F.col(content_col), "UTF-8")
    content = F.coalesce(content, F.lit(bytearray(b"")))
    key = F.col(id_col).cast("string")
    name = F.col(name_col).cast("string") if name_col else key
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    return df.select(key.alias("blob_id"), name.alias("name"), name.alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"), label.alias("label"))


def expand_zips(blobs: DataFrame, max_entry: int | None = None) -> DataFrame:
    """Blobs, with each .zip replaced by its entries (path zip#inner). Directories, entries larger than max_entry
    (none by default), archives and entries that can't be read give no rows; archives inside archives stay as they are. Entries are sent back
    some SENT_BYTES at a time, however many a batch of archives holds."""
    is_zip = F.lower("name").endswith(".zip")

    def sent(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["blob_id", "name", "path", "length", "content", "label"])

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for r in pdf.itertuples():
                try:
                    z = zipfile.ZipFile(BytesIO(bytes(r.content)))
                except (zipfile.BadZipFile, EOFError):
                    continue
                for e in z.infolist():
                    if e.is_dir() or max_entry is not None and e.file_size > max_entry:
                        continue
                    try:
                        data = z.read(e)
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                        continue
                    rows.append((f"{r.blob_id}#{e.filename}", e.filename.rpartition("/")[2], f"{r.path}#{e.filename}", len(data), data, r.label))
                    held += len(data)
                    if held >= SENT_BYTES or len(rows) >= SENT_ROWS:
                        yield sent(rows)
                        rows, held = [], 0
            yield sent(rows)

    return blobs.where(~is_zip | is_zip.isNull()).unionByName(blobs.where(is_zip).mapInPandas(entries, BLOBS))


def save_hashes(hashes: DataFrame, root: str, text: bool = False) -> None:
    """Write (name, algo, hash) as parquet by algorithm; with text, also as lines `hash name` below a header."""
    hashes.write.mode("overwrite").partitionBy("algo").parquet(f"{root}/store")
    if not text:
        return
    spark = hashes.sparkSession
    for algo in ALGORITHMS:
        own = hashes.where(F.col("algo") == algo)
        head = ["# warning: generated file, changes will be lost", "# generated by: bytelake", f"# algorithm: {algo}", f"# count: {own.count()}", f"# timestamp: {datetime.now(UTC).isoformat(timespec='seconds')}", "# version: 2"]
        lines = spark.createDataFrame([(h,) for h in head], "value string").coalesce(1)
        lines.unionByName(own.select(F.concat_ws(" ", "hash", "name").alias("value"))).write.mode("overwrite").text(f"{root}/text/{algo}")


def load_hashes(spark: SparkSession, path: str, algo: str) -> tuple[DataFrame, dict[str, str]]:
    """(name, algo, hash) from lines `hash name`, and the header's entries."""
    lines = spark.read.text(path)
    entry = r"^# (\w+(?: \w+)?): ?(.*)$"
    head = {r[0]: r[1] for r in lines.where(F.col("value").rlike(entry)).select(F.regexp_extract("value", entry, 1), F.regexp_extract("value", entry, 2)).collect()}
    line = r"^(\S+) (.*)$"
    rows = lines.where(~F.col("value").startswith("#") & F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 2).alias("name"), F.lit(algo).alias("algo"), F.regexp_extract("value", line, 1).alias("hash")), head


def hash_store(blobs: DataFrame, root: str) -> DataFrame:
    """The stored hashes where all algorithms are there, else those of the blobs, stored first."""
    from bytelake.operators.hashing import hash_table

    spark = blobs.sparkSession
    try:
        stored = spark.read.parquet(f"{root}/store")
        if {r[0] for r in stored.select("algo").distinct().collect()} >= set(ALGORITHMS):
            return stored
    except Exception as e:  # noqa: BLE001  (a store that isn't there)
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    save_hashes(hash_table(blobs), root)
    return spark.read.parquet(f"{root}/store")


def save_training_data(features: DataFrame, labels: DataFrame, root: str) -> None:
    features.write.mode("overwrite").parquet(f"{root}/features")
    labels.write.mode("overwrite").partitionBy("label").parquet(f"{root}/labels")


def load_training_data(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/features"), spark.read.parquet(f"{root}/labels")
