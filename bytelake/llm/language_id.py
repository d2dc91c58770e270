"""Language ID: text likelihoods, declared language, address suffix and smoothed host priors, fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Cells of hashed byte trigrams, and the trigrams' weight: so many count in full.
CELLS, WEIGHT = 8_192, 60.0
#: Languages that a model may have (64 KB each, in every task); with more, fit_text raises an error.
MOST_LANGUAGES = 512
#: Pages that a level of the host hierarchy counts as much as the level above it.
PRIOR = 5.0
#: Chance, before it is read, that a text is in none of the languages: its trigrams are then evenly spread over CELLS.
UNKNOWN = 0.01
_TAGS = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"


def cells(text: str | None) -> np.ndarray:
    """Counts of a text's byte trigrams (lower-cased, white space and signs as one space), hashed to CELLS."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    raw = np.where((raw >= 97) & (raw <= 122) | (raw >= 128), raw, 32)
    raw = raw[(raw != 32) | (np.append(0, raw[:-1]) != 32)]
    if len(raw) < 3:
        return np.zeros(CELLS, np.int64)
    h = (raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * np.uint32(2654435761) >> np.uint32(19)
    return np.bincount(h.astype(np.int64), minlength=CELLS)


def fit_text(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All languages by falling number of documents, log-probabilities of their trigrams, counted over all documents, and their sums.

    None is left out: where there are more than `most`, it raises a ValueError.
    """
    named = docs.where(F.col(lang).isNotNull() & (F.trim(lang) != "")).select(F.lower(F.trim(lang)).alias("lang"), F.col(text).cast("string").alias("t"))
    langs = [r["lang"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()] or ["und"]
    if len(langs) > most:
        raise ValueError(f"more than {most} languages in {lang}; clean the column or raise `most`")
    at = {x: i for i, x in enumerate(langs)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), CELLS), np.int64)
        for rb in C.pieces(batches):
            for x, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                if x in at:
                    total[at[x]] += cells(t)
        p = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(total.reshape(-1)[p])], ["p", "c"])

    rows = named.mapInArrow(go, "p int, c long").groupBy("p").agg(F.sum("c").alias("c")).toArrow()  # at most most * CELLS rows
    total = np.full(len(langs) * CELLS, 0.5)
    total[rows["p"].to_numpy()] += rows["c"].to_numpy()
    total = total.reshape(len(langs), CELLS)
    return langs, np.log(total / total.sum(1, keepdims=True)), total.sum(1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True)


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.reshape(-1))


def _likelihoods(rows: DataFrame, logp, langs: list[str], sums: np.ndarray | None = None) -> DataFrame:
    """Adds ll (log-likelihoods by language), p (their shares; zero without trigrams) and n (trigrams) for column t, which goes.

    With the sums of fit_text, rows are those it learned from, and a text doesn't count for its own declared language.
    """
    known = {x: i for i, x in enumerate(langs)}
    keep = [c for c in rows.columns if c != "t"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = logp.value.T.copy()
        for rb in C.pieces(batches):
            ll, n = np.zeros((rb.num_rows, table.shape[1])), np.zeros(rb.num_rows, np.int64)
            own = [None if sums is None else known.get(x) for x in rb.column(rb.schema.get_field_index("declared")).to_pylist()]
            for i, t in enumerate(rb.column(rb.schema.get_field_index("t")).to_pylist()):
                c = cells(t)
                n[i] = c.sum()
                if n[i]:
                    at = np.flatnonzero(c)
                    ll[i] = c[at] @ table[at] * (min(n[i], WEIGHT) / n[i])
                    if (d := own[i]) is not None:
                        others = np.maximum(np.exp(table[at, d]) * sums[d] - c[at], 0.5)
                        ll[i, d] = c[at] @ np.log(others / (sums[d] - n[i])) * (min(n[i], WEIGHT) / n[i])
            p = _softmax(ll) * (n > 0)[:, None]
            yield pa.RecordBatch.from_arrays([*(rb.column(rb.schema.get_field_index(c)) for c in keep), _lists(ll), _lists(p), pa.array(n)], [*keep, "ll", "p", "n"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(go, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", ll array<double>, p array<double>, n long")


def identify(rows: DataFrame, langs: list[str], logp: np.ndarray, unknown: float = 0.0, learned: np.ndarray | None = None) -> DataFrame:
    """From (id, t, declared, host, ...): id, lang, confidence, declared, host and other columns. See identify_pages for the cases.

    Evidence of a row: its text under each language; the declared language, by how often rows of each language
    (as their text says) declare it; the host's prior, from the sums of other rows' text evidence on that host,
    smoothed towards its domain, that towards the address suffix, and that towards all rows. All sums are
    grouped aggregates; a host with very many rows is summed in parts, and its one row is joined back. With a chance `unknown` of a text
    in no language, that competes too: its trigrams are even, it declares what rows declare on the whole, and where
    it is likeliest the language is und with confidence 0. learned: the sums of fit_text, see _likelihoods.
    """
    spark, m = rows.sparkSession, range(len(langs))
    others_of = {c: t for c, t in rows.dtypes if c not in ("id", "t", "declared", "host")}
    sent = spark.sparkContext.broadcast(logp)
    known = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNull(), "none").otherwise("other")
    host = F.coalesce("host", F.lit(""))
    suffix_of = F.element_at(F.split("host", r"\."), -1)
    labels = F.split(F.concat(F.lit(".."), "host"), r"\.")
    short = (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.element_at(labels, -2)) <= 3)  # such as co.uk
    domain_of = F.array_join(F.when(short, F.slice(labels, -3, 3)).otherwise(F.slice(labels, -2, 2)), ".")
    seen = _likelihoods(rows.withColumn("host", host), sent, langs, learned)
    seen = C.materialize(seen.withColumns({"said": known, "suffix": suffix_of, "domain": domain_of}))
    parts = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in m]

    # Log-chance that a row of language i declares d, from at most MOST_LANGUAGES + 2 groups.
    said = {r["said"]: np.array([r[f"s{i}"] for i in m]) for r in seen.groupBy("said").agg(*parts).collect()}
    total = sum(said.values(), np.full(len(langs), len(langs) + 2.0))
    declares = {d: np.log((v + 1.0) / total) for d, v in said.items()}
    common = {d: float(np.log((v.sum() + 1.0) / (sum(x.sum() for x in said.values()) + len(langs) + 2.0))) for d, v in said.items()}

    every = np.array([x or 0.0 for x in seen.agg(*parts).first()])
    sums = lambda keys, name: seen.groupBy(*keys).agg(*parts).select(*keys, F.array(*(f"s{i}" for i in m)).alias(name))
    hosts = sums(["suffix", "domain", "host"], "at_host").join(sums(["suffix", "domain"], "at_domain"), ["suffix", "domain"]).join(sums(["suffix"], "at_suffix"), "suffix")
    hosts = hosts.select("host", "at_host", "at_domain", "at_suffix")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in C.pieces(batches):
            col = lambda c: rb.column(rb.schema.get_field_index(c))
            ll, p, *levels = (col(c).flatten().to_numpy().reshape(rb.num_rows, len(langs)) for c in ("ll", "p", "at_suffix", "at_domain", "at_host"))
            prior = np.full(len(langs), 1 / len(langs))
            for level in (every, *levels):  # each without the row itself, smoothed towards the one above
                others = np.maximum(level - p, 0)
                prior = (others + PRIOR * prior) / (others.sum(1, keepdims=True) + PRIOR)
            prior = np.log(prior)
            says = col("said").to_pylist()
            score, n = ll + prior + np.array([declares[x] for x in says]).reshape(ll.shape), col("n").to_numpy()
            if unknown:
                none = np.log(unknown) - np.minimum(n, WEIGHT) * np.log(CELLS) + np.array([common[x] for x in says])
                score = np.c_[score + np.log1p(-unknown), none]
            post = _softmax(score)
            best = post.argmax(1)
            blank = (n == 0) & np.array([x == "none" for x in says], bool) | (best == len(langs))
            lang = ["und" if b else langs[i] for b, i in zip(blank, best, strict=True)]
            conf = np.where(blank, 0.0, post[np.arange(len(best)), best])
            yield pa.RecordBatch.from_arrays([col("id"), pa.array(lang, pa.string()), pa.array(conf), col("declared"), col("host"), *map(col, others_of)], ["id", "lang", "confidence", "declared", "host", *others_of])

    out = seen.join(hosts, "host").select("id", "declared", "host", *others_of, "said", "n", "ll", "p", "at_suffix", "at_domain", "at_host")
    return out.mapInArrow(fuse, ", ".join(["id long, lang string, confidence double, declared string, host string", *(f"{c} {t}" for c, t in others_of.items())]))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, lang, confidence, declared, host. Text likelihoods are learned from docs(text, lang).

    A page's text is its html without tags, scripts, styles, comments and entities. Without text the declared
    language and the host decide; without text and declaration the language is und with confidence 0. Null urls
    share the empty host. Repeated rows and null ids are rows like others; an empty table gives no rows; other
    columns are ignored. With no labelled document every page is und.
    """
    langs, logp, _ = fit_text(docs)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), _TAGS, " ").alias("t"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)), F.lit("")).alias("declared"),
        F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1)).alias("host"),
    )
    return identify(rows, langs, logp).withColumnRenamed("id", "page_id")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those in no known language: no letters, whatever they declare, an unknown language more likely
    than the known ones, or a confidence below `least`. All columns stay.

    lang is the declared language, source the host. Rows with a null doc_id stay. Rows of one doc_id are judged each by
    its own text; only those of one id and text go together.
    """
    langs, logp, sums = fit_text(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"), F.lower(F.trim(F.col("lang"))).alias("declared"), F.col("source").cast("string").alias("host"), F.xxhash64(F.col("text").cast("string")).alias("x"))
    found = identify(rows, langs, logp, UNKNOWN, sums)
    lost = found.where((F.col("lang") == "und") | (F.col("confidence") < least)).select("id", "x")
    letterless = rows.where(~F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False))).select("id", "x")
    return C.drop_texts(docs, lost.unionByName(letterless))
