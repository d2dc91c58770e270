"""A store of hashes that grows with its corpus: bucketed by hash, filled only with what is new or changed."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.operators.hashing import ALGORITHMS, find_by_hash, hash_table

#: Buckets of a new store. Lookups of large request tables are dealt to as many tasks.
BUCKETS = 256
#: Paths of an increment up to which the scan that hashes them is filtered by a broadcast.
BROADCAST_PATHS = 1 << 20
_ROWS = "algo string, hash string, name string, path string, length long, time timestamp"
_FILES = "path string, length long, time timestamp"


class HashStore:
    """Hashes of files below `root` (a folder that all machines see), as two tables.

    `hashes` (algo, hash, name, path, length, time) is bucketed and sorted by hash, so that a lookup moves requests and
    not the store. `files` (path, length, time) says which rows are valid: the state of each path when it was last merged.
    A merge appends rows for paths that are new or whose length or time changed, and then writes the next version of
    files; a merge that breaks off leaves rows that no version names. Rows of earlier states stay until `compact`. One merge
    runs at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        known = self._read("settings", "buckets int")
        self.buckets = known.first()[0] if known is not None else buckets
        if known is None:
            spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{self.root}/settings")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else None

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/files")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/files/{n}/_SUCCESS"))]
        return sorted(int(n) for n in done if n.isdigit())

    def files(self) -> DataFrame:
        """path, length, time of all merged files."""
        v = self._versions()
        return self.spark.read.schema(_FILES).parquet(f"{self.root}/files/{v[-1]}") if v else self.spark.createDataFrame([], _FILES)

    def _folder(self) -> str:
        name = self._read("current", "folder string")
        return name.orderBy(F.desc("folder")).first()[0] if name is not None else "hashes"

    def _table(self) -> str:
        """The bucketed table, known to this session's catalogue by its folder."""
        folder = f"{self.root}/{self._folder()}"
        name = f"bytelake_hashes_{zlib.crc32(folder.encode()):08x}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_ROWS}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return name

    def rows(self) -> DataFrame:
        """All rows, those of earlier states too. Bucketed by hash."""
        return self.spark.table(self._table())

    def hashes(self) -> DataFrame:
        """Valid rows: name, algo, hash, path."""
        return self._valid(self.rows()).select("name", "algo", "hash", "path")

    def _valid(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.files(), ["path", "length", "time"], "left_semi")

    def merge(self, files: DataFrame) -> int:
        """Hash what is new or changed of files(path, name, length, time, content) and return how many that were.

        Paths that the store knows and files doesn't have stay; see `forget`. Paths, lengths and times are compared without
        reading content; then the content of what is new is read. A path that comes twice counts once, by its last time.
        """
        now = files.groupBy("path").agg(F.max_by(F.struct("length", "time"), F.col("time")).alias("s")).select("path", "s.length", "s.time")
        new = now.join(self.files(), ["path", "length", "time"], "left_anti")
        part = f"{self.root}/new/{uuid.uuid4().hex}"
        new.write.parquet(part)
        new = self.spark.read.schema(_FILES).parquet(part)
        n = new.count()
        if n:
            wanted = F.broadcast(new) if n <= BROADCAST_PATHS else new
            content = files.join(wanted, ["path", "length", "time"], "left_semi")
            self._append(hash_table(content, ALGORITHMS, "path", "length", "time").dropDuplicates(["path", "algo"]))
            self._replace_files(self.files().join(new.select("path"), "path", "left_anti").unionByName(new))
        return n

    def forget(self, paths: DataFrame) -> None:
        """Take paths(path) out of the store."""
        self._replace_files(self.files().join(paths.select("path").distinct(), "path", "left_anti"))

    def _append(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in _ROWS.split(", ")]
        rows.select(*names).repartition(self.buckets, "hash").write.insertInto(self._table())
        self.spark.catalog.refreshTable(self._table())

    def _replace_files(self, files: DataFrame) -> None:
        version = (self._versions() or [0])[-1] + 1
        files.write.mode("overwrite").parquet(f"{self.root}/files/{version}")

    def compact(self) -> None:
        """Write valid rows to a new table, with one file a bucket, and use it from now on. The old one stays for those who
        still read it."""
        before = self._read("current", "folder string")
        own, n = self._valid(self.rows()), 1 + (before.count() if before is not None else 0)
        folder = f"hashes_{n:06d}_{uuid.uuid4().hex}"
        name = f"bytelake_hashes_{zlib.crc32(f'{self.root}/{folder}'.encode()):08x}"
        names = [c.split()[0] for c in _ROWS.split(", ")]
        own.select(*names).repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.root}/{folder}").format("parquet").saveAsTable(name)
        self.spark.createDataFrame([(folder,)], "folder string").write.mode("append").parquet(f"{self.root}/current")

    def find(self, algo: str, requests: DataFrame) -> DataFrame:
        """The rows of find_by_hash for requests(hash). The store isn't shuffled: requests are dealt to its buckets, and of
        what they meet the valid rows are kept."""
        if algo not in ALGORITHMS:
            raise ValueError(f"unknown hash algorithm: {algo}")
        asked = requests.select(F.lower("hash").alias("hash")).distinct()
        met = self.rows().where(F.col("algo") == algo).join(asked, "hash", "left_semi")
        return find_by_hash(self._valid(met), algo, asked)
