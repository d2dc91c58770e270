"""Embedding near-dedup: sign hashing by random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelake.llm import common as C

#: Vectors of a block in the comparison of large buckets.
BLOCK = 128
#: Chance with which a pair exactly at the threshold meets in a table or more; closer pairs meet more often.
RECALL = 0.995


def plan_tables(largest: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits a table and number of tables: bits keep buckets of unrelated vectors near 1/4 member, tables give
    the recall at the threshold. Both grow with the logarithm of the largest label's number of vectors."""
    bits = min(60, max(8, math.ceil(math.log2(max(largest, 2))) + 2))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([20240901, dim]).standard_normal((dim, tables * bits))


def _sign(reps: DataFrame, tables: int, bits: int, width: str) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(bits, dtype=np.int64))[None, None, :]
        for rb in C.pieces(batches):
            vec = rb.column("vec")
            at = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False)
            dims = np.diff(at)
            sigs = np.zeros((rb.num_rows, tables), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = _planes(int(d), tables, bits)
                m = flat[at[rows][:, None] + np.arange(d)[None, :]].astype(np.float64)
                up = (m @ planes[d] > 0).reshape(len(rows), tables, bits)
                sigs[rows] = (up * weight).sum(2)
            raw = [flat[a:b].astype(width).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rb.column("k"), rb.column("label"), pa.array(dims.astype(np.int32)), rb.column("mult"), pa.array(raw, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.ListArray.from_arrays(np.arange(0, sigs.size + 1, tables, dtype=np.int32), sigs.reshape(-1))],
                ["k", "label", "dim", "mult", "vec", "sig", "sigs"],
            )

    return reps.mapInArrow(go, "k long, label string, dim int, mult long, vec binary, sig binary, sigs array<bigint>")


def _compare(threshold: float, width: str):
    def f(tb: pa.Table) -> dict | None:
        if tb.num_rows < 2:
            return None
        ids, dim, mult, own = (tb.column(c).to_numpy() for c in ("k", "dim", "mult", "own"))
        label = tb.column("label").to_numpy()
        t = int(tb.column("t")[0].as_py())
        may = (label[:, None] == label[None, :]) & (dim[:, None] == dim[None, :]) & (ids[:, None] != ids[None, :])
        if tb.column("bi")[0] != tb.column("bj")[0]:
            may &= own[:, None] != own[None, :]
        if not may.any():
            return None
        sig = np.stack([np.frombuffer(x, np.int64) for x in tb.column("sig").to_pylist()])
        for earlier in range(t):  # a pair counts in the first table in which it meets
            may &= sig[:, earlier][:, None] != sig[:, earlier][None, :]
        may &= sig[:, t][:, None] == sig[:, t][None, :]
        use = np.flatnonzero(may.any(1))
        if not len(use):
            return None
        cos = np.zeros((len(use), len(use)))
        for d in np.unique(dim[use]):
            own_d = np.flatnonzero(dim[use] == d)
            m = np.stack([np.frombuffer(tb.column("vec")[int(i)].as_py(), width) for i in use[own_d]]).astype(np.float64)
            m /= np.abs(m).max(1, keepdims=True)
            norm = np.sqrt((m * m).sum(1))
            cos[np.ix_(own_d, own_d)] = (m @ m.T) / (norm[:, None] * norm[None, :])
        linked = may[np.ix_(use, use)] & (cos >= threshold)
        some = linked.any(1)
        if not some.any():
            return None
        ids, n = ids[use], linked.astype(np.int64) @ mult[use]
        root = ids.copy()
        a, b = C.forest(ids, linked)
        at = dict(zip(a.tolist(), b.tolist(), strict=True))
        root = np.array([at.get(i, i) for i in ids.tolist()], np.int64)
        return {"k": ids[some], "n": n[some], "root": root[some]}

    return f


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they are of one length and their cosine, in double
    precision, is at least `threshold`. Vectors that are null, empty, zero or hold null, NaN or infinite
    components, and vectors without label, link with nothing: n_links 0, component_id their own id, kept. A null
    vec_id links with nothing and gets a null component_id. Repeated rows count once; one vec_id with several
    vectors has a row for each, and is one node of the graph: its rows share their links' number and component. An empty table gives no rows. Other columns are ignored.

    Equal vectors collapse to their smallest id, with their number. The rest is hashed by the signs of random
    projections in several tables; vectors of one bucket are compared exactly in blocks of bounded size, a pair
    only in the first table in which it meets, so that links are counted without listing them. Each block gives
    a spanning forest of its links, joined by distributed components.
    """
    spark = vectors.sparkSession
    e = F.col(embedding)
    double = not isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)  # floats stay, all else is compared as it is
    width = "<f8" if double else "<f4"
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("k"), F.col(label).cast("string").alias("label"), e.cast("array<double>" if double else "array<float>").alias("vec"))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec"), "dim": F.coalesce(F.size("vec"), F.lit(-1))})
    fit = F.coalesce(F.col("k").isNotNull() & F.col("label").isNotNull() & (F.col("dim") > 0) & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fit", fit)
    ids = C.materialize(rows.select("k", "label", "h1", "h2", "dim", "fit").distinct())
    key = ["label", "h1", "h2", "dim"]
    mult = ids.where("fit").groupBy(*key).agg(F.count("*").alias("mult"))
    reps = rows.where("fit").groupBy(*key).agg(F.min("k").alias("k"), F.first("vec").alias("vec")).join(mult, key)
    reps = C.materialize(reps)
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan_tables(largest, threshold)
    signed = C.materialize(_sign(reps.select("k", "label", "vec", "mult"), tables, bits, width))
    posts = signed.select("k", "label", "dim", F.posexplode("sigs").alias("t", "s")).select("k", "t", F.xxhash64("label", "dim", "t", "s").alias("key"))
    full = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    posts = posts.join(full, "key")
    cells = C.block_pairs(posts, "key", "c", "k", BLOCK).join(signed.drop("sigs"), "k")
    cells = cells.select("key", "bi", "bj", "own", "t", "k", "label", "dim", "mult", "vec", "sig")
    found = C.materialize(C.run_groups(cells, ["key", "bi", "bj"], _compare(threshold, width), "k long, n long, root long", ["k", "n", "root"]))
    links = found.groupBy("k").agg(F.sum("n").alias("n"))
    comp = C.components(found, "k", "root").withColumnRenamed("id", "k")
    known = reps.select(*key, "k", "mult").join(links, "k", "left").join(comp, "k", "left")
    known = known.select(*key, (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "k").alias("c"), F.lit(True).alias("fit"))
    out = ids.join(known, [*key, "fit"], "left")
    component = F.coalesce("c", "k")
    return out.select(
        F.col("k").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"),
    )


#: The rows of near_vectors over embeddings, by all pairs of a label.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
u AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(any_value(k), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY vec_id
"""
