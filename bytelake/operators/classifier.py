"""One-vs-rest nearest centroids: training as aggregation, prediction in one pass, on sparse features.

A feature that a blob lacks counts as 0, which normalises to z0. Sums over present features and z0 give the same
centroids and distances as full vectors, without making them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Cells (a feature and a class, about 64 bytes with names) of a model that a task holds as a matrix.
MATRIX_CELLS = 1 << 20
#: Parts that the rows of a feature beyond the matrix are dealt to.
SALTS = 32
#: Rows times classes that a task works on at once.
AT_ONCE = 1 << 20


@dataclass
class Model:
    """scaling(feature, min, max, z0, n: training blobs that have it), centroids(feature, label, pos, neg),
    classes(label, class_idx, n_pos, n_neg, weight); a new one has sums, of which save makes the first two."""

    scaling: DataFrame
    centroids: DataFrame
    classes: DataFrame
    sums: DataFrame | None = None

    def save(self, root: str) -> None:
        """Write the tables. Features are read once, for sums, which are written first."""
        self.classes.write.mode("overwrite").parquet(f"{root}/classes")
        scaling, centroids = self.scaling, self.centroids
        if self.sums is not None:
            spark = self.classes.sparkSession
            self.sums.write.mode("overwrite").parquet(f"{root}/sums")
            sums, classes = spark.read.parquet(f"{root}/sums"), spark.read.parquet(f"{root}/classes")
            scaling, centroids = scaling_of(sums), centroids_of(sums, classes)
        scaling.write.mode("overwrite").parquet(f"{root}/scaling")
        centroids.write.mode("overwrite").parquet(f"{root}/centroids")

    @staticmethod
    def load(spark: SparkSession, root: str) -> Model:
        return Model(*(spark.read.parquet(f"{root}/{name}") for name in ("scaling", "centroids", "classes")))


def stratified_split(labels: DataFrame, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """labels(blob_id, label) with a boolean test: of each class, max(1, round(n * ratio)) by a hash of id and seed.

    Rows are ranked inside cells of a class, 4,096 ranges of the hash; counts of cells, some 4,096 rows a class, give
    each cell its place. So no task holds a class.
    """
    names = labels.columns
    rows = labels.withColumn("_h", F.xxhash64(F.lit(seed), F.col("blob_id").cast("string"))).withColumn("_cell", F.shiftright("_h", 52))
    cells = rows.groupBy("label", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("label").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    size = F.greatest(F.lit(1), F.floor(F.sum("_n").over(Window.partitionBy("label")) * ratio + 0.5))
    cells = cells.select(F.col("label").alias("_label"), F.col("_cell").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), size.alias("_size"))
    rank = F.row_number().over(Window.partitionBy("label", "_cell").orderBy("_h", "blob_id"))
    ranked = rows.withColumn("_rank", rank).join(cells, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_cell") == F.col("_at")))
    return ranked.select(*names, (F.col("_rank") + F.col("_before") <= F.col("_size")).alias("test"))


def fit_scaling(features: DataFrame) -> DataFrame:
    """Least and largest value of each feature over the blobs that have it, and z0. A NaN makes both NaN."""
    nan = F.max(F.isnan("value"))
    own = features.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), nan.alias("nan"))
    own = own.select("feature", *(F.when(F.col("nan"), float("nan")).otherwise(F.col(c)).alias(c) for c in ("min", "max")))
    return own.withColumn("z0", _scaled(F.lit(0.0)))


def _scaled(v: Column) -> Column:
    same = F.col("max") == F.col("min")
    return F.when(same, F.when(v == F.col("min"), 0.5).otherwise(0.0)).otherwise((v - F.col("min")) / F.when(~same, F.col("max") - F.col("min")))


def normalise(features: DataFrame, scaling: DataFrame) -> DataFrame:
    """blob_id, feature, z, z0 of known features."""
    return features.join(scaling, "feature").select("blob_id", "feature", _scaled(F.col("value")).alias("z"), "z0")


def class_weights(labels: DataFrame, boosted: str = "vic20", boost: float = 1.5, boost_most: float = 4.0, most: float = 3.0) -> DataFrame:
    """label, class_idx, n_pos, n_neg, weight: min(4, 1.5 * neg / pos) for the boosted class; else min(3, neg / pos)
    where that is over 1; else 1."""
    own = labels.groupBy("label").agg(F.count("*").alias("n_pos"))
    every = Window.partitionBy()  # a row a class
    own = own.withColumn("n_neg", F.sum("n_pos").over(every) - F.col("n_pos")).withColumn("class_idx", F.row_number().over(Window.orderBy("label")) - 1)
    ratio = F.col("n_neg") / F.col("n_pos")
    weight = F.when(F.col("n_neg") == 0, 1.0).when(F.col("label") == boosted, F.least(F.lit(boost_most), boost * ratio)).when(ratio > 1, F.least(F.lit(most), ratio)).otherwise(1.0)
    return own.select("label", "class_idx", "n_pos", "n_neg", weight.alias("weight"))


def fit_centroids(scaled: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean scaled vector of each class's members and of the others; an empty side is 0."""
    own = scaled.join(labels.select("blob_id", "label"), "blob_id").groupBy("feature", "label").agg(F.sum("z").alias("s"), F.count("*").alias("n"), F.first("z0").alias("z0"))
    return _centroids(own, classes)


def _centroids(own: DataFrame, classes: DataFrame) -> DataFrame:
    """From sums of scaled values s and their numbers n, by feature and label."""
    every = own.groupBy("feature").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"), F.first("z0").alias("z0"))
    cells = every.join(F.broadcast(classes), how="cross").join(own.drop("z0"), ["feature", "label"], "left").na.fill({"s": 0.0, "n": 0})  # a row a class
    side = lambda s, n, size: F.when(size > 0, (s + (size - n) * F.col("z0")) / F.when(size > 0, size)).otherwise(0.0)
    pos = side(F.col("s"), F.col("n"), F.col("n_pos"))
    neg = side(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n"), F.col("n_neg"))
    return cells.select("feature", "label", pos.alias("pos"), neg.alias("neg"))


def feature_sums(features: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, label, s, n, min, max, nan: what training needs to know of features(blob_id, feature, value), one value
    for each pair, in one pass. A feature that all blobs have is summed where it is read."""
    own = features.join(labels.select("blob_id", "label"), "blob_id").groupBy("feature", "label")
    return own.agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.max(F.isnan("value")).alias("nan"))


def scaling_of(sums: DataFrame) -> DataFrame:
    """The rows of fit_scaling, with n, from feature_sums."""
    own = sums.groupBy("feature").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.max("nan").alias("nan"), F.sum("n").alias("n"))
    own = own.select("feature", *(F.when(F.col("nan"), float("nan")).otherwise(F.col(c)).alias(c) for c in ("min", "max")), "n")
    return own.select("feature", "min", "max", _scaled(F.lit(0.0)).alias("z0"), "n")


def centroids_of(sums: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of fit_centroids from feature_sums: scaling is linear, so sums of scaled values come from sums of values,
    and no value meets its feature's scaling. A feature with one value only is scaled to 0.5 wherever it is."""
    scaling = scaling_of(sums)
    one = F.col("max") == F.col("min")
    scaled = F.when(one, 0.5 * F.col("n")).otherwise((F.col("s") - F.col("n") * F.col("min")) / F.when(~one, F.col("max") - F.col("min")))
    own = sums.select("feature", "label", "s", "n").join(scaling.drop("n"), "feature").select("feature", "label", scaled.alias("s"), "n", "z0")
    return _centroids(own, classes)


def train_ensemble(features: DataFrame, labels: DataFrame, **weights) -> Model:
    """A model from features(blob_id, feature, value), one value for each pair, and labels(blob_id, label)."""
    sums, classes = feature_sums(features, labels), class_weights(labels, **weights)
    return Model(scaling_of(sums), centroids_of(sums, classes), classes, sums)


def _steps(features: DataFrame, sent) -> DataFrame:
    """blob_id, class_idx, pos, neg: for each blob of a batch, what its features of the broadcast matrix add to its squared
    distances. sent: features' names, a row (min, max, z0) of each, and its centroids, pos and neg, by class."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scale, pos, neg = sent.value
        place, k = {f: i for i, f in enumerate(names)}, pos.shape[1]
        for rb in batches:
            for at in range(0, rb.num_rows, max(1, AT_ONCE // max(k, 1))):
                rows = rb.slice(at, max(1, AT_ONCE // max(k, 1)))
                feature = rows.column(1).dictionary_encode()
                known = np.array([place.get(f, -1) for f in feature.dictionary.to_pylist()] + [-1])
                i = known[feature.indices.fill_null(-1).to_numpy()]
                use = np.flatnonzero(i >= 0)
                if not len(use):
                    continue
                i, v = i[use], rows.column(2).cast(pa.float64()).fill_null(np.nan).to_numpy()[use]
                low, high, z0 = scale[i].T
                with np.errstate(all="ignore"):
                    z = np.where(high == low, np.where(v == low, 0.5, 0.0), (v - low) / (high - low))
                z = np.where(np.isnan(z), 0.0, z)
                blob = rows.column(0).take(pa.array(use)).dictionary_encode()
                n = len(blob.dictionary)
                cell = (blob.indices.to_numpy()[:, None] * k + np.arange(k)).ravel()
                # (z - c)^2 - (z0 - c)^2
                sums = [np.bincount(cell, ((z - z0)[:, None] * ((z + z0)[:, None] - 2 * c[i])).ravel(), n * k) for c in (pos, neg)]
                yield pa.RecordBatch.from_arrays([blob.dictionary.take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k), n), pa.int32()), *map(pa.array, sums)], ["blob_id", "class_idx", "pos", "neg"])

    return features.select(F.col("blob_id").cast("string").alias("blob_id"), F.col("feature").cast("string").alias("feature"), "value").mapInArrow(go, "blob_id string, class_idx int, pos double, neg double")


def class_scores(features: DataFrame, blobs: DataFrame, model: Model) -> DataFrame:
    """blob_id, label, class_idx, score: d- / (d+ + d-) times the class's weight, 0.5 where both are 0. Every blob of
    blobs(blob_id) has a row a class, also one without any feature.

    Centroids of the features that most training blobs have, as many as MATRIX_CELLS allows, are a matrix in each task:
    rows add up to one a blob and class where they are read. Those of rarer features, if there are more, are joined by
    (feature, part of the blobs), so that no task gets all rows of a feature. The model should be a saved one: its
    tables are read several times.
    """
    spark = features.sparkSession
    zero = lambda c: F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)
    scaling = model.scaling if "n" in model.scaling.columns else model.scaling.withColumn("n", F.lit(0))
    cells = model.centroids.join(scaling.select("feature", "z0"), "feature")
    z0, pos, neg = zero(F.col("z0")), zero(F.col("pos")), zero(F.col("neg"))
    base = cells.groupBy("label").agg(F.sum((z0 - pos) * (z0 - pos)).alias("base_pos"), F.sum((z0 - neg) * (z0 - neg)).alias("base_neg"))

    known, kinds = scaling.count(), model.classes.count()
    held = max(1, MATRIX_CELLS // max(kinds, 1))
    inside = scaling.select("feature", "min", "max", z0.alias("z0"), "n")
    inside = inside if known <= held else inside.orderBy(F.desc("n"), "feature").limit(held)
    place = model.classes.select("label", "class_idx")
    per = model.centroids.join(place, "label").groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("class_idx", pos.alias("pos"), neg.alias("neg")))).alias("c"))
    matrix = inside.join(per, "feature").toArrow()  # at most MATRIX_CELLS cells, or one feature
    c = matrix.column("c").combine_chunks().flatten()
    side = [c.field(s).to_numpy().reshape(matrix.num_rows, -1) if matrix.num_rows else np.zeros((0, max(kinds, 1))) for s in ("pos", "neg")]
    scale = np.stack([matrix.column(x).to_numpy() for x in ("min", "max", "z0")], 1)
    sums = _steps(features, spark.sparkContext.broadcast((matrix.column("feature").to_pylist(), scale, *side)))
    if known > held:
        names = spark.createDataFrame(matrix.select(["feature"]))
        rest = features.join(F.broadcast(names), "feature", "left_anti").withColumn("_salt", F.pmod(F.xxhash64("blob_id"), F.lit(SALTS)).cast("int"))
        others = scaling.select("feature", "min", "max", z0.alias("z0")).join(F.broadcast(names), "feature", "left_anti").join(per, "feature")
        others = others.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rest.join(others, ["feature", "_salt"]).withColumn("z", zero(_scaled(F.col("value")))).select("blob_id", "z", "z0", F.inline("c"))
        step = lambda x: (F.col("z") - F.col("z0")) * (F.col("z") + F.col("z0") - 2 * F.col(x))
        sums = sums.unionByName(met.select(F.col("blob_id").cast("string").alias("blob_id"), "class_idx", step("pos").alias("pos"), step("neg").alias("neg")))
    sums = sums.groupBy("blob_id", "class_idx").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    kind = model.classes.join(base, "label", "left").select(F.struct("label", "class_idx", "weight", "base_pos", "base_neg").alias("k"))
    full = blobs.select("blob_id").join(F.broadcast(kind) if kinds <= MATRIX_CELLS else kind, how="cross").select("blob_id", "k.*").withColumn("class_idx", F.col("class_idx").cast("int"))
    full = full.join(sums.withColumnRenamed("blob_id", "_id"), (F.col("blob_id").cast("string") == F.col("_id")) & (full["class_idx"] == sums["class_idx"]), "left").drop("_id", sums["class_idx"]).na.fill(0.0, ["pos", "neg", "base_pos", "base_neg"])

    def distance(side: str) -> Column:
        d2 = F.col(f"base_{side}") + F.col(side)
        return F.sqrt(F.when(d2 < 1e-12 * F.col(f"base_{side}"), 0.0).otherwise(F.greatest(d2, F.lit(0.0))))

    full = full.withColumns({"dp": distance("pos"), "dn": distance("neg")})
    score = F.when((F.col("dp") == 0) & (F.col("dn") == 0), 0.5).when(F.col("dp") == 0, 1.0).when(F.col("dn") == 0, 0.0).otherwise(F.col("dn") / (F.col("dp") + F.col("dn")))
    return full.select("blob_id", "label", "class_idx", (score * F.col("weight")).alias("score"))


def predict(scores: DataFrame) -> DataFrame:
    """blob_id, predicted, confidence, all_scores: the largest score; of equal ones the earlier class."""
    return scores.groupBy("blob_id").agg(
        F.max_by("label", F.struct(F.round("score", 12), -F.col("class_idx"))).alias("predicted"),
        F.max("score").alias("confidence"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "score")))).alias("all_scores"),
    )


def ranked_scores(scores: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("blob_id").orderBy(F.desc(F.round("score", 12)), "class_idx"))
    return scores.select("blob_id", "label", "score", rank.alias("rank"))


def confusion_matrix(judged: DataFrame, classes: DataFrame) -> DataFrame:
    """actual, predicted, cnt with zeros, from (actual, predicted)."""
    own = judged.groupBy("actual", "predicted").agg(F.count("*").alias("cnt"))
    c = classes.select("label")
    grid = c.withColumnRenamed("label", "actual").crossJoin(c.withColumnRenamed("label", "predicted"))  # classes by classes
    return grid.join(own, ["actual", "predicted"], "left").na.fill(0, ["cnt"])


def class_distribution(judged: DataFrame) -> DataFrame:
    own = judged.groupBy("actual").agg(F.count("*").alias("cnt"))
    return own.withColumn("percent", 100 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))  # a row a class


def evaluate(confusion: DataFrame) -> DataFrame:
    """label, precision, recall, f1 and the overall accuracy; 0 where there is nothing to divide by."""
    right = F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0)
    by = lambda c: confusion.groupBy(F.col(c).alias("label"))
    real = by("actual").agg(F.sum("cnt").alias("real"), F.sum(right).alias("right"))
    said = by("predicted").agg(F.sum("cnt").alias("said"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    out = real.join(said, "label").select("label", part("right", "said").alias("precision"), part("right", "real").alias("recall"), "right", "real")
    total = Window.partitionBy()  # a row a class
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both)).otherwise(0.0)
    return out.select("label", "precision", "recall", f1.alias("f1"), (F.sum("right").over(total) / F.sum("real").over(total)).alias("accuracy"))


def render_report(metrics: DataFrame, confusion: DataFrame, title: str = "", **facts: str) -> str:
    """Fixed-width text of run facts (such as time, model size, pipeline), accuracy, class distribution, metrics and the
    matrix, from tables of a row a class (or a pair)."""
    rows = metrics.orderBy("label").collect()
    cells = {(r["actual"], r["predicted"]): r["cnt"] for r in confusion.collect()}
    names = [r["label"] for r in rows]
    real = {a: sum(cells.get((a, p), 0) for p in names) for a in names}
    every, right = sum(real.values()), sum(cells.get((a, a), 0) for a in names)
    lines = [title] if title else []
    lines += [f"{k}: {v}" for k, v in facts.items()]
    lines += [f"Accuracy: {100 * rows[0]['accuracy']:.2f}% ({right}/{every})" if rows else "Accuracy: -"]
    lines += [f"{'class':<12}{'files':>11}{'percent':>11}"] + [f"{a:<12}{real[a]:>11}{100 * real[a] / max(every, 1):>10.2f}%" for a in names]
    lines += [f"{'class':<12}{'precision':>11}{'recall':>11}{'f1':>11}"]
    lines += [f"{r['label']:<12}{r['precision']:>11.4f}{r['recall']:>11.4f}{r['f1']:>11.4f}" for r in rows]
    lines += [" " * 12 + "".join(f"{n:>11}" for n in names)] + [f"{a:<12}" + "".join(f"{cells.get((a, p), 0):>11}" for p in names) for a in names]
    return "\n".join(lines)


def append_report(spark: SparkSession, root: str, text: str, **facts: str) -> None:
    """Append one run's report to a table."""
    spark.createDataFrame([(text, facts)], "report string, facts map<string,string>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(root)
