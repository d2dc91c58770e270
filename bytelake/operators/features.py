"""Feature pipelines: extractors in order, one long table of features, the last value of a name wins."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.functions import gram_key
from bytelake.operators import grams, signatures, stats

Extractor = Callable[[DataFrame], DataFrame]


#: The n-grams counted last in this worker: n, the blob's bytes and the parts, of a blob of one chunk.
_last: list = [0, None, None]


def _parts(b: np.ndarray, n: int) -> Iterable[grams.Counted]:
    """counted_parts, counted once for extractors of equal n that follow one another."""
    if len(b) > grams.CHUNK:
        return grams.counted_parts(b, n)
    if _last[0] != n or _last[1] is not b:
        _last[:] = n, b, list(grams.counted_parts(b, n))
    return _last[2]


def ngram_extractor(n: int, k: int, strategy: str = "frequency", frequencies: DataFrame | None = None, documents: int = 0) -> Extractor:
    """ngram_total_count, _unique_count, _diversity, _distribution and the k n-grams that the strategy (frequency,
    entropy or tfidf) selects: ngram_<key> and, but for tfidf, ngram_<key>_norm. Blobs shorter than n have none."""
    if strategy not in ("frequency", "entropy", "tfidf"):
        raise ValueError(f"unknown strategy: {strategy}")

    names = ["ngram_total_count", "ngram_unique_count", "ngram_diversity", "ngram_distribution"]

    def values(b: np.ndarray, k: int = k, strategy: str = strategy) -> tuple[list[str], list[float]]:
        total = len(b) - n + 1
        if total <= 0:
            return [], []
        (_, _, first), score, norm, distinct, squares = grams.best_of_parts(_parts(b, n), total, k, strategy)
        found, out = list(names), [float(total), float(distinct), distinct / total, squares]
        for i, x, y in zip(first.tolist(), score.tolist(), norm.tolist(), strict=True):
            key = "ngram_" + b[i : i + n].tobytes().hex("_")
            found += [key, f"{key}_norm"]
            out += [x, y]
        return found, out

    def extract(blobs: DataFrame) -> DataFrame:
        if strategy != "tfidf":
            return stats.feature_rows(blobs, [(0, values)]).drop("extractor_idx")
        head = stats.feature_rows(blobs, [(0, lambda b: values(b, 0, "frequency"))]).drop("extractor_idx")
        if frequencies is None:
            best = grams.best_grams(blobs, n, k)
        else:
            best = grams.best_tfidf(blobs, frequencies, n, k, documents or None)
        return head.unionByName(best.select("blob_id", (3 + F.col("rank")).cast("int").alias("emit_idx"), F.concat(F.lit("ngram_"), gram_key("packed", n)).alias("feature"), F.col("score").alias("value")))

    extract.__name__ = f"ngram({n}, {k}, {strategy})"
    if strategy != "tfidf":
        extract.values = values
        extract.prefixes = ("ngram_",)
    return extract


def apart(*groups: list[Extractor]) -> bool:
    """Whether extractors of different groups never emit one name, as far as they declare what their names begin with."""
    named = [[p for f in g for p in getattr(f, "prefixes", ("",))] for g in groups]
    return not any(x.startswith(y) or y.startswith(x) for i, a in enumerate(named) for b in named[i + 1 :] for x in a for y in b)


@dataclass
class FeaturePipeline:
    """Extractors take a blob table and return blob_id, emit_idx, feature, value; a user's own are of the same form."""

    extractors: list[Extractor] = field(default_factory=list)

    def add(self, extractor: Extractor) -> FeaturePipeline:
        return FeaturePipeline([*self.extractors, extractor])

    def extract(self, blobs: DataFrame, last: bool = False) -> DataFrame:
        """blob_id, extractor_idx, emit_idx, feature, value of all extractors; with last, only the last value of a name.

        Those that have `values` (a function of a blob's bytes) share one pass of a helper, those that have `array` (a
        column of rows) one projection: content is read twice at most, and the last value of a name is known where the blob
        is read. Of those with `values`, the ones with `fixed` names that no other extractor emits go as arrays. Where names of the two kinds may be equal, by the `prefixes` that extractors declare, the projection's rows
        go through the helper. Others run by themselves; only with them does last need a shuffle.
        """
        if not self.extractors:
            raise ValueError("a pipeline needs an extractor")
        parts, helped, arrays, fixed = [], [], [], []
        for i, f in enumerate(self.extractors):
            if hasattr(f, "fixed") and (not last or apart([f], self.extractors[:i] + self.extractors[i + 1 :])):
                fixed.append((i, f.fixed))
            elif hasattr(f, "values"):
                helped.append((i, f.values))
            elif hasattr(f, "array"):
                arrays.append((i, f.array))
            else:
                parts.append(f(blobs).select("blob_id", F.lit(i).alias("extractor_idx"), F.col("emit_idx").cast("int").alias("emit_idx"), "feature", F.col("value").cast("double").alias("value")))
        if arrays:
            rows = blobs.select("blob_id", "length", "content")
            for i, f in arrays:
                rows = f(rows, f"_rows{i}")
            all_rows = F.concat(*[F.transform(f"_rows{i}", lambda r, i=i: F.struct(F.lit(i).alias("extractor_idx"), r["emit_idx"].cast("int").alias("emit_idx"), r["feature"].alias("feature"), r["value"].cast("double").alias("value"))) for i, _ in arrays])
            rows = rows.select("blob_id", "content", all_rows.alias("_rows"))
            of = lambda held: [self.extractors[i] for i, _ in held]
            if last and not (apart(*([f] for f in of(arrays))) and apart(of(arrays), of(helped))):
                parts.append(stats.feature_rows(rows, helped, last, "_rows"))
                helped = []
            else:
                parts.append(rows.select("blob_id", F.inline_outer("_rows")))
        if helped or fixed:
            parts.append(stats.feature_rows(blobs, helped, last, fixed=fixed))
        rows = functools.reduce(DataFrame.unionByName, parts)
        own = sum(hasattr(f, "values") or hasattr(f, "array") for f in self.extractors)
        return resolved(rows) if last and own < len(self.extractors) and len(parts) > 1 else rows

    def describe(self) -> str:
        return "\n".join(f"{i + 1}. {f.__name__}" for i, f in enumerate(self.extractors))


def preset(name: str = "default") -> FeaturePipeline:
    """full, ngram, signature, streamlined (also default) or balanced; any other name gives full."""
    hist, ent, length, pairs = stats.histogram, stats.entropy_features, stats.length_features, stats.bigram_features
    sig, load, g = signatures.enhanced_signature_features, signatures.load_address_features, ngram_extractor
    streamlined = [ent, length, sig, g(1, 16, "entropy"), g(2, 16, "entropy"), g(3, 20, "entropy"), g(3, 20), g(4, 12)]
    presets = {
        "full": [hist, ent, length, pairs, sig, g(3, 30)],
        "ngram": [hist, length, g(2, 16), g(3, 16), g(4, 12, "entropy")],
        "signature": [sig],
        "streamlined": streamlined,
        "default": streamlined,
        "balanced": [load, ent, length, sig, g(1, 10, "entropy"), g(2, 10, "entropy"), g(3, 16, "entropy")],
    }
    return FeaturePipeline(list(presets.get(name, presets["full"])))


def resolved(features: DataFrame) -> DataFrame:
    """Of the rows of each blob and feature the one emitted last."""
    best = F.max_by(F.struct("extractor_idx", "emit_idx", "value"), F.struct("extractor_idx", "emit_idx"))
    return features.groupBy("blob_id", "feature").agg(best.alias("r")).select("blob_id", "r.extractor_idx", "r.emit_idx", "feature", "r.value")


def resolve_features(features: DataFrame) -> DataFrame:
    """One value for each blob and feature, the one emitted last, from rows of any pipeline. Where a pipeline is at hand,
    its extract(blobs, last=True) gives them without a shuffle."""
    return features.groupBy("blob_id", "feature").agg(F.max_by("value", F.struct("extractor_idx", "emit_idx")).alias("value"))


def top_features(features: DataFrame, k: int = 10) -> DataFrame:
    """The k features of each blob that are largest by absolute value, without zeros; ties by name."""
    rank = F.row_number().over(Window.partitionBy("blob_id").orderBy(F.desc(F.abs("value")), "feature"))
    return features.where("value != 0").select("blob_id", "feature", "value", rank.alias("rank")).where(F.col("rank") <= k)
