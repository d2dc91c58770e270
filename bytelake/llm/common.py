"""What several operators share: cutting lineage, word shingles, streams of groups, components."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's table of word hashes; others are hashed again each time.
WORD_CACHE = 300_000

#: Rows and bytes of a piece of an Arrow batch that a task works on at once.
PIECE_ROWS, PIECE_BYTES = 1_000, 8 << 20

_own: dict[str, str] = {}
_tables: list[DataFrame] = []


class Tables:
    """The intermediate tables of one run, to be deleted together when what reads them is written."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def release(self) -> None:
        release(*self.held)
        self.held = []


_owner: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("owner", default=None)


def owner() -> Tables | None:
    return _owner.get()


@contextlib.contextmanager
def owned(tables: Tables) -> Iterator[Tables]:
    """Tables that operators write inside belong to `tables`."""
    before = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir. In local mode, where it is unset, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="bytelake-")
        folder = _own[app]
    return folder.rstrip("/")


def materialize(df: DataFrame, *measures: Column) -> DataFrame | tuple[DataFrame, dict]:
    """Write df to the shared folder and read it back, which cuts its lineage and outlives executors.

    With measures, also return their values, taken while writing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    (df.observe(seen, *measures) if measures else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    _tables.append(out)
    if owner() is not None:
        owner().held.append(out)
    return (out, seen.get) if measures else out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialize wrote, once nothing that is still to run reads them."""
    for t in tables:
        if t is not None and t in _tables:
            _tables.remove(t)
            delete(t.sparkSession, t._table)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release_all() -> None:
    """For applications: delete all tables that operators hold in this process, when all results are written: those that
    are not can't be read any more. A run that owns its tables (see owned) deletes those alone."""
    release(*list(_tables))


def small_batches(spark: SparkSession, rows: int = PIECE_ROWS) -> None:
    """For applications, not operators: let Arrow batches of this session hold no more rows than that (Spark's own limit
    is 64 MB each), so that workers stay small where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows and about so many bytes (one row at least): texts may be long."""
    for rb in batches:
        at = 0
        while at < rb.num_rows:
            n = min(rows, rb.num_rows - at)
            while n > 1 and rb.slice(at, n).nbytes > size:
                n //= 2
            yield rb.slice(at, n)
            at += n


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to WORD_CACHE."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of bytes other than space and \\t to \\r. Null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def roll(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; shorter input gives none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mix(words[:n])
    for k in range(1, size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return h


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document; with fewer words, its whole sequence as one."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(roll(words, min(size, len(words))))


def hash_words(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = split_words(text)
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def run_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict | None], schema: str, names: list[str]) -> DataFrame:
    """Apply fn to each group of rows with equal keys (no nulls), as a stream over sorted partitions.

    fn gets an Arrow table and returns columns by name, or None. Memory is bounded by one group and one
    Arrow batch; callers keep groups small. Many small groups cost far less than with applyInPandas.
    """

    def starts(tb: pa.Table) -> np.ndarray:
        new = np.zeros(tb.num_rows, bool)
        new[0] = True
        for k in keys:
            v = tb.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def emit(found: list[dict]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[n] for x in found])) for n in names], names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rb in batches:
            if not rb.num_rows:
                continue
            if held and all(held[-1].column(k)[held[-1].num_rows - 1] == rb.column(k)[rb.num_rows - 1] for k in keys):
                held.append(rb)
                continue
            tb = pa.Table.from_batches([*held, rb]).combine_chunks()
            at = starts(tb)
            yield from emit([x for a, b in zip(at[:-1], at[1:], strict=True) if (x := fn(tb.slice(a, b - a)))])
            held = tb.slice(at[-1]).combine_chunks().to_batches()
        if held:
            tb = pa.Table.from_batches(held).combine_chunks()
            yield from emit([x for x in [fn(tb)] if x])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, schema)


def block_pairs(df: DataFrame, group: str, count: str, member: str, block: int) -> DataFrame:
    """Deal each group's members to cells (bi, bj) of block pairs, so that any two members of a group meet
    in exactly one cell and no cell holds more than about 2 * block rows. Adds bi, bj and own (the member's
    block): in a cell with bi < bj only members of different blocks are to be compared.
    """
    nb = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.col(group)), nb).cast("int")
    cells = df.withColumns({"own": own, "_nb": nb}).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return cells.withColumns({"bi": F.least("own", "_j"), "bj": F.greatest("own", "_j")}).drop("_nb", "_j")


def forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) that join the same rows as the symmetric matrix `linked`."""
    order = np.argsort(ids, kind="stable")
    adj = linked[np.ix_(order, order)].copy()
    np.fill_diagonal(adj, True)
    lab = np.arange(len(ids))
    while True:
        new = np.where(adj, lab[None, :], len(ids)).min(1)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    moved = lab != np.arange(len(ids))
    s = ids[order]
    return s[moved], s[lab[moved]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (id, component), component the smallest reachable id.

    Each round points every vertex at its least neighbour, follows that pointer once, and contracts: edges are
    drawn between what their ends point at, loops and repeats go. Edges shrink by a factor a round and rounds
    grow with the logarithm of the longest chain. Joins have one row a key on one side and may be split on the
    other, so a hub with very many neighbours is no single task. Every round is written to the shared folder;
    only one number a round reaches the driver. Vertices without edges are absent.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    rest = materialize(edges.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    labels = None
    while True:
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("l")))
        of = near.select(F.col("id").alias("by"), F.col("l").alias("to"))
        at = materialize(near.join(of, near.l == of.by).select("id", F.col("to").alias("l")))
        x, y = at.select(F.col("id").alias("u"), F.col("l").alias("x")), at.select(F.col("id").alias("v"), F.col("l").alias("y"))
        new = rest.join(x, "u").join(y, "v").where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        left, seen = materialize(new, F.count("*").alias("n"))
        release(near, rest)
        if labels is None:
            labels = at
        else:
            to = at.select(F.col("id").alias("by"), F.col("l").alias("to"))
            moved = materialize(labels.join(to, labels.l == to.by, "left").select("id", F.coalesce("to", "l").alias("l")))
            release(labels, at)
            labels = moved
        rest = left
        if not seen["n"]:
            release(rest)
            return labels.withColumnRenamed("l", "component")


#: Ids up to which a list of ids is broadcast (8 bytes each).
BROADCAST_IDS = 1 << 20


def fresh(df: DataFrame, *names: str) -> Iterator[str]:
    """The names, each with underscores before it until df has no column of that name."""
    held = {c.lower() for c in df.columns}
    for n in names:
        while n in held:
            n = f"_{n}"
        held.add(n)
        yield n


def drop_texts(df: DataFrame, lost: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of df but for those whose key and text are a row of lost: (id, x), x the text's xxhash64. Other texts of an id
    stay, as do rows with a null key. A list of proven size is broadcast, a longer one shuffled."""
    k, x = fresh(df, "lost_id", "lost_text")
    lost = lost.where(F.col(lost.columns[0]).isNotNull()).distinct().toDF(k, x)
    lost, seen = materialize(lost, F.count("*").alias("n"))
    same = (df[key].cast("long") == F.col(k)) & (F.xxhash64(df[text].cast("string")) == F.col(x))
    return df.join(F.broadcast(lost) if seen["n"] <= BROADCAST_IDS else lost, same, "left_anti")


def drop_rows(df: DataFrame, lost: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys, none of them null, aren't those of a row of lost. A list of proven size is broadcast, a longer one shuffled."""
    lost, seen = materialize(lost.select(*keys).distinct(), F.count("*").alias("n"))
    return df.join(F.broadcast(lost) if seen["n"] <= BROADCAST_IDS else lost, keys, "left_anti")


def bitmap(wanted: DataFrame, key: str, bits: int = 1 << 22):
    """A broadcast bitmap of fixed size (bits / 8 bytes) in which each key's bit, key mod bits, is set."""
    p = F.pmod(F.col(key), F.lit(bits))
    words = wanted.select(F.shiftright(p, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(pmod({key}, {bits}) % 64 AS INT))").alias("b"))
    full = np.zeros(bits // 64, np.int64)
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # no more than bits / 64 rows
    full[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(full.astype("<i8").view(np.uint8))


def hits(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def split_by_bitmap(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key may be in wanted's first column, for a join that decides exactly, and all others, those with a
    null key among them. No row of df is moved: the bitmap's words, no more than bits / 64, are broadcast and joined.
    """
    word, mask = fresh(df, "bit_word", "bit_mask")
    place = lambda c: F.pmod(c.cast("long"), F.lit(bits))
    at = place(F.col(wanted.columns[0]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = materialize(wanted.groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(bit).alias(mask)).where(F.col(word).isNotNull()))
    own = place(df[key])
    seen = df.join(F.broadcast(words), F.shiftright(own, 6) == F.col(word), "left")
    there = F.coalesce(F.getbit(mask, (own % 64).cast("int")) == 1, F.lit(False))
    return seen.where(there).drop(word, mask), seen.where(~there).drop(word, mask)


def reduce_by_bitmap(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """Drop rows of df whose key surely isn't in wanted(key), before a join that decides exactly.

    With more keys the bitmap only passes more rows. Null keys are dropped.
    """
    sent = bitmap(wanted, key, bits)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            k = rb.column(rb.schema.get_field_index(key))
            keep = k.is_valid().to_numpy(zero_copy_only=False) & hits(sent.value, k.fill_null(0).to_numpy(zero_copy_only=False))
            yield rb.filter(pa.array(keep))

    return df.mapInArrow(go, df.schema)
