"""License scan: exact set-similarity join of text blocks with notice templates. DataFrame functions only."""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Part of a template's words, in percent, that a block holds at least.
PERCENT = 90
#: Words of a template's piece, and of a block; longer lines are overlapping blocks that hold each PIECE words whole.
PIECE, BLOCK = 32, 64
#: Words of templates up to which they are broadcast (about 100 bytes each).
BROADCAST_WORDS = 1 << 17
# Phrases that are counted as they stand, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Published notices of licenses (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("epl", "made available under the terms of the Eclipse Public License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, null as empty. Spark's lower differs beyond ASCII only, and is far faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def words_of(low: Column) -> Column:
    """Words of a lower-cased text: runs of a-z, 0-9 and characters beyond ASCII."""
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "label string, text string")


def count_phrases(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """rows (low, words, ...) with n_base, first_word, last_word and base_labels (array): places where the words of a
    phrase stand one after the other."""
    # Each word has a space on either side, so that phrases next to each other share none.
    spaced = F.when(functools.reduce(lambda a, b: a | b, [F.contains("low", F.lit(p.split()[-1])) for p in phrases]), F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise("")
    rows = rows.withColumn("_s", spaced)
    n_in = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")
    parts = {p: f"_p{i}" for i, p in enumerate(phrases)}
    rows = rows.withColumns({c: F.split("_s", rf"\Q {'  '.join(p.split())} \E") for p, c in parts.items()})
    count = {p: F.size(c) - 1 for p, c in parts.items()}
    first = [F.when(count[p] > 0, n_in(F.get(c, F.lit(0)))) for p, c in parts.items()]
    last = [F.when(count[p] > 0, F.size("words") - n_in(F.get(c, count[p])) - len(p.split())) for p, c in parts.items()]
    label = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(count[p] > 0, phrases[p]) for p in phrases)))))
    some = lambda pick, c: pick(*c) if len(c) > 1 else c[0]
    rows = rows.withColumns({"n_base": sum(count.values()).cast("long"), "first_word": some(F.least, first), "last_word": some(F.greatest, last), "base_labels": label})
    return rows.drop("_s", *parts.values())


def _pieces(templates: DataFrame, percent: int) -> DataFrame:
    """(label, tid, pieces, piece, own, m, o): the templates' pieces of PIECE words, their m distinct words, and how many
    of these a block must hold."""
    rows = templates.select(F.col("label").cast("string").alias("label"), words_of(lower_az(F.col("text").cast("string"))).alias("w"))
    rows = rows.where("label IS NOT NULL AND size(w) > 0").distinct().withColumn("tid", F.xxhash64("label", "w"))
    rows = rows.withColumn("pieces", F.ceil(F.size("w") / F.lit(PIECE)).cast("int"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.withColumn("own", F.array_distinct(F.slice("w", F.col("piece") * PIECE + 1, F.lit(PIECE))))
    return rows.select("label", "tid", "pieces", "piece", "own", F.size("own").alias("m"), F.ceil(F.size("own") * F.lit(percent) / 100).cast("int").alias("o"))


def find_templates(docs: DataFrame, templates: DataFrame, percent: int = PERCENT, cut: str = "\n") -> DataFrame:
    """(doc_id, x, label, share) from docs(doc_id, x, low): each label of which a template is found in a text.

    A block is a line (what lies between matches of `cut`); a line of more than BLOCK words is overlapping blocks, so that
    each PIECE words lie in one. A block matches a template's piece if it holds `percent` of the piece's distinct
    words. A template is found if `percent` of its pieces are; share is the mean over its pieces of the best part held.

    The join is exact. Words of templates are ordered by their number in all docs, rarest first; words that no template
    holds make no difference. A block that holds o of a piece's m words holds one of its first m - o + 1: blocks without
    any of those go at once, in the scan. The others are kept once for each different block, however many documents
    hold it, reduced to template words in that order, and joined by the words of their prefixes; blocks of too few words
    go (length filter), as do pairs whose words from the shared ones on are too few on either side (positional filter).
    What is left is intersected, at the pair's first shared word, so that no pair is verified twice. A template whose words
    are all in another's is found wherever that one is.
    """
    pieces = C.materialize(_pieces(templates, percent))
    vocabulary = C.materialize(pieces.select(F.explode("own").alias("token")).distinct())
    small = (lambda df: F.broadcast(df)) if vocabulary.count() <= BROADCAST_WORDS and pieces.count() <= BROADCAST_WORDS // PIECE else (lambda df: df)
    counted = docs.select(F.explode(words_of(F.col("low"))).alias("token")).join(small(vocabulary), "token").groupBy("token").agg(F.count("*").alias("c"))
    order = C.materialize(vocabulary.join(counted, "token", "left").select("token", F.coalesce("c", F.lit(0)).alias("c")))

    key = ["tid", "piece"]
    sorted_ = pieces.select(*key, F.explode("own").alias("token")).join(order, "token").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
    sorted_ = C.materialize(pieces.drop("own").join(sorted_, key).withColumn("t", F.col("t.token")))
    prefix = sorted_.select("label", "pieces", *key, "m", "o", "t", F.posexplode(F.slice("t", F.lit(1), F.col("m") - F.col("o") + 1)).alias("p", "token"))
    least = sorted_.agg(F.min("o")).first()[0]

    lines = docs.select("doc_id", "x", F.explode(F.split("low", cut)).alias("line")).select("doc_id", "x", words_of(F.col("line")).alias("w"))
    at = lines.select("doc_id", "x", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - PIECE - 1, F.lit(0)), F.lit(BLOCK - PIECE))).alias("i"))
    blocks = at.select("doc_id", "x", F.slice("w", F.col("i") + 1, F.lit(BLOCK)).alias("b"))
    hit = blocks.select("doc_id", "x", "b", F.explode("b").alias("token")).join(small(prefix.select("token").distinct()), "token")
    hit = C.materialize(hit.select("doc_id", "x", F.xxhash64("b").alias("h1"), F.xxhash64(F.lit(1), "b").alias("h2"), "b"))

    own = hit.groupBy("h1", "h2").agg(F.first("b").alias("b")).select("h1", "h2", F.explode(F.array_distinct("b")).alias("token"))
    own = own.join(small(order), "token").groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("b"))
    own = own.select("h1", "h2", F.col("b.token").alias("b"), F.size("b").alias("n")).where(F.col("n") >= (least or 0))
    own = own.select("h1", "h2", "b", "n", F.posexplode(F.slice("b", F.lit(1), F.col("n") - (least or 0) + 1)).alias("i", "token"))
    near = own.join(small(prefix), "token").where((F.col("n") >= F.col("o")) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("p")) >= F.col("o")))
    both = F.array_intersect("t", "b")
    near = near.withColumn("both", both).where((F.get("both", F.lit(0)) == F.col("token")) & (F.size("both") >= F.col("o")))
    near, seen = C.materialize(near.select("h1", "h2", "label", "pieces", *key, (F.size("both") / F.col("m")).alias("part")), F.count("*").alias("n"))

    places = hit.select("doc_id", "x", "h1", "h2").distinct().join(F.broadcast(near) if seen["n"] <= C.BROADCAST_IDS // 8 else near, ["h1", "h2"])
    best = places.groupBy("doc_id", "x", "label", "pieces", *key).agg(F.max("part").alias("part"))
    found = best.groupBy("doc_id", "x", "label", "pieces", "tid").agg((F.sum("part") / F.first("pieces")).alias("share"), F.count("*").alias("held"))
    found = found.where(100 * F.col("held") >= percent * F.col("pieces")).groupBy("doc_id", "x", "label").agg(F.max("share").alias("share"))
    return found


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, phrases: dict[str, str] = PHRASES, cut: str = "\n") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, shares.

    Words are runs of a-z, 0-9 and characters beyond ASCII in the text with A-Z lower-cased. n_base counts the places
    where a phrase's words stand one after the other, first_word and last_word are the smallest and largest of their
    starts (null without one), base_labels their labels. labels adds those of the templates found by find_templates;
    shares (map) says how much of them. Labels are distinct, sorted and joined by a comma, empty if there are none. score is 1
    where a phrase stands, else the largest share, 0 without one. templates: (label, text), TEMPLATES by default; those
    with a null label or without words are left out, repeated ones count once.

    Null and empty texts have no words. Repeated rows come back repeated; rows of one doc_id with different texts, and
    rows with a null doc_id, are judged each for itself. An empty table gives no rows; without templates only phrases
    count. Other columns are ignored, whatever their names.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    base = base.select("doc_id", F.xxhash64("t").alias("x"), lower_az(F.col("t")).alias("low"))
    found = find_templates(base, templates, percent, cut).groupBy("doc_id", "x").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "share")))).alias("shares"))
    found, seen = C.materialize(found.withColumnsRenamed({"doc_id": "_d", "x": "_x"}), F.count("*").alias("n"))
    rows = count_phrases(base.withColumn("words", words_of(F.col("low"))), phrases).withColumn("n_words", F.size("words").cast("long")).drop("low", "words")
    rows = rows.join(F.broadcast(found) if seen["n"] <= C.BROADCAST_IDS // 8 else found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("x") == F.col("_x")), "left")
    shares = F.coalesce("shares", F.create_map().cast("map<string,double>"))
    labels = F.array_sort(F.array_union("base_labels", F.map_keys(shares)))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.map_values(shares)), F.lit(0.0))).alias("score"),
        shares.alias("shares"),
    )


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _places(phrase: str) -> str:
    return f"list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))})"


#: The rows of the query, without shares, by all pairs of blocks and templates.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOW.format("text")} AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p AS (SELECT *, {", ".join(f"{_places(p)} AS p{i}" for i, p in enumerate(PHRASES))} FROM w),
b AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, {" || ".join(f"p{i}" for i in range(len(PHRASES)))} AS spots,
  list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS base FROM p),
l AS (SELECT r, regexp_extract_all(line, '{_WORD}') AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
k AS (SELECT DISTINCT r, list_distinct(ws[i + 1:i + {BLOCK}]) AS ws FROM (SELECT r, ws, unnest(range(0, greatest(len(ws) - {PIECE}, 1), {BLOCK - PIECE})) AS i FROM l WHERE len(ws) > 0)),
t AS (SELECT label, list_distinct(regexp_extract_all({_LOW.format("text")}, '{_WORD}')) AS ts FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)}) v(label, text)),
f AS (SELECT r, label, len(list_intersect(ws, ts)) / len(ts) AS share FROM k, t WHERE 100 * len(list_intersect(ws, ts)) >= {PERCENT} * len(ts)),
g AS (SELECT r, list(DISTINCT label) AS found, max(share) AS share FROM f GROUP BY r)
SELECT doc_id, n_words, len(spots)::BIGINT AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ','), '') AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN g USING (r)
"""
