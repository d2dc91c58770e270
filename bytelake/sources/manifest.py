"""A manifest of a corpus: directories are listed in tasks, and again only those that changed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A directory changed less than so many seconds before it was listed is listed again next time.
FRESH = 3.0
#: Bytes of files in a batch that a task reads.
READ = 32 << 20
_SEEN = "dir string, parent string, mtime double, listed boolean, path string, name string, length long, time timestamp, is_dir boolean"
_DIRS = "dir string, parent string, mtime double, listed boolean"
_FILES = "dir string, path string, name string, length long, time timestamp"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _list(rows: DataFrame, again: bool) -> DataFrame:
    """From (dir, parent, known): a row for each directory as it is now and, where its time isn't the known one, a row for
    each entry. Directories that are gone give no rows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dir", pa.string()), ("parent", pa.string()), ("mtime", pa.float64()), ("listed", pa.bool_()), ("path", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("time", pa.timestamp("us", "UTC")), ("is_dir", pa.bool_())])
        for rb in batches:
            out = []
            for uri, parent, known in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                system, path = _open(uri)
                info = system.get_file_info(path)
                if info.type != fs.FileType.Directory:
                    continue
                # A store without times of directories has None: such directories are always listed.
                now = None if info.mtime_ns is None or time.time() - info.mtime_ns / 1e9 < FRESH else info.mtime_ns / 1e9
                listed = again or now is None or now != known
                out.append((uri, parent, now, listed, None, None, None, None, True))
                if listed:
                    for e in system.get_file_info(fs.FileSelector(path)):
                        if e.base_name[0] not in "._" and e.type in (fs.FileType.File, fs.FileType.Directory):
                            out.append((uri, parent, now, listed, f"{uri.rstrip('/')}/{e.base_name}", e.base_name, e.size, e.mtime, e.type == fs.FileType.Directory))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return rows.select("dir", "parent", "known").mapInArrow(go, _SEEN)


class Manifest:
    """The files below `corpus`, in tables below `root` (a folder that all machines see): `dirs` (dir, parent, mtime,
    listed) and `files` (dir, path, name, length, time), a version for each update.

    Updates go down the tree, a level a round, in tasks: each directory's time is asked for, and only if it isn't that
    of the last version the directory is listed; what is known of others stays. Only counts reach the driver. A file that
    is written over in place doesn't change its directory's time: update(again=True) lists all. Names that begin with . or _
    are skipped. Locations are those that pyarrow's file systems open (local and mounted paths, object stores, HDFS).
    """

    def __init__(self, spark: SparkSession, corpus: str, root: str) -> None:
        self.spark, self.corpus, self.root = spark, corpus.rstrip("/"), root.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/files")
        system = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit() and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/files/{n}/_SUCCESS")))

    def _table(self, name: str, version: int | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version}") if version else self.spark.createDataFrame([], schema)

    def files(self, version: int | None = None) -> DataFrame:
        """dir, path, name, length, time of the last version, or of the one named."""
        v = self._versions()
        return self._table("files", version if version is not None else v[-1] if v else None, _FILES)

    def dirs(self) -> DataFrame:
        """dir, parent, mtime, listed: whether the last update listed it."""
        v = self._versions()
        return self._table("dirs", v[-1] if v else None, _DIRS)

    def update(self, again: bool = False) -> DataFrame:
        """Bring the manifest up to date; returns the files that are new or changed: path, name, length, time."""
        old = (self._versions() or [0])[-1]
        known, files = self._table("dirs", old, _DIRS), self._table("files", old, _FILES)
        work, rounds = f"{self.root}/new/{uuid.uuid4().hex}", 0
        frontier = self.spark.createDataFrame([(self.corpus, None)], "dir string, parent string")
        while True:
            ask = frontier.join(known.select("dir", F.col("mtime").alias("known")), "dir", "left")
            _list(ask.repartition(self.spark.sparkContext.defaultParallelism) if rounds else ask, again).write.parquet(f"{work}/{rounds}")
            seen = self.spark.read.schema(_SEEN).parquet(f"{work}/{rounds}")
            below = seen.where("listed AND is_dir AND path IS NOT NULL").select(F.col("path").alias("dir"), F.col("dir").alias("parent"))
            same = seen.where("NOT listed").select(F.col("dir").alias("_up"))
            frontier = below.unionByName(known.join(same, known["parent"] == F.col("_up"), "left_semi").select("dir", "parent"))
            rounds += 1
            if not frontier.limit(1).count():
                break
        seen = self.spark.read.schema(_SEEN).parquet(*(f"{work}/{i}" for i in range(rounds)))
        kept = files.join(seen.where("NOT listed").select("dir").distinct(), "dir", "left_semi")
        now = seen.where("NOT is_dir").select("dir", "path", "name", "length", "time").unionByName(kept)
        seen.where("path IS NULL").select("dir", "parent", "mtime", "listed").write.mode("overwrite").parquet(f"{self.root}/dirs/{old + 1}")
        now.write.mode("overwrite").parquet(f"{self.root}/files/{old + 1}")
        return self.files().join(files, ["path", "length", "time"], "left_anti").select("path", "name", "length", "time")


def read_content(files: DataFrame) -> DataFrame:
    """files(path, name, length, time) with content, read where the row is. Files that are gone or can't be read give no
    row. Rows are dealt out first, so that a few directories' files don't make a few tasks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            held, size = [], 0
            for i, path in enumerate(rb.column(0).to_pylist()):
                try:
                    system, at = _open(path)
                    with system.open_input_stream(at) as f:
                        data = f.read()
                except OSError:
                    continue
                held.append((i, data))
                size += len(data)
                if size >= READ:
                    yield send(rb, held)
                    held, size = [], 0
            if held:
                yield send(rb, held)

    def send(rb: pa.RecordBatch, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        rows = rb.take(pa.array([i for i, _ in held], pa.int64()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([d for _, d in held], pa.binary())], [*rows.schema.names, "content"])

    rows = files.select("path", "name", "length", "time")
    return rows.repartition(F.xxhash64("path")).mapInArrow(go, "path string, name string, length long, time timestamp, content binary")
