"""Benchmark decontamination by templates of typed placeholders. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelake.llm import common as C

#: Tokens of a window, the part of an item's windows that must be found, and the plain words a window needs.
WINDOW, PART, PLAIN = 8, 0.5, 3
#: Windows of all items up to which they are broadcast (about 60 bytes each).
BROADCAST_WINDOWS = 1 << 19
# Units, as they follow numbers.
UNITS = "km m cm mm mi miles mile ft feet inches kg g mg lb lbs pounds oz l ml s sec seconds minutes hours days weeks months years mph kmh usd eur gbp dollars euros cents percent % $ € £ °".split()
_NAMES = r"\p{Lu}[\p{Ll}\p{M}]+(?![\p{L}\p{M}])"
# Groups repeat possessively: Java's matcher recurses once a repetition otherwise, so that a run of some thousand names or
# a number of as many parts overflows a task's stack. Nothing follows them, so they match the same.
_TOKEN = rf"\p{{N}}+(?:[.,]\p{{N}}+)*+|{_NAMES}(?:\s+{_NAMES})*+|[\p{{L}}\p{{M}}]+|[%$€£°]"
_NUMBER, _NAME, _UNIT = "<number>", "<name>", "<unit>"


def tokens(text: Column) -> Column:
    """Numbers, words and currency or unit signs of a text; capitalised words with only white space between them
    (a name of several words) are one token. Null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def template(word: Column) -> Column:
    """A placeholder for numbers, units and names (words of a capital, then small letters); else lower case."""
    first, low = F.substring(word, 1, 1), F.lower(word)
    rest = F.substring(word, 2, 1 << 30)
    return (
        F.when(((first >= "0") & (first <= "9")) | ((first > "\x7f") & first.rlike(r"^\p{N}")), _NUMBER)
        .when((F.lower(first) != first) & (rest != "") & ((F.lower(rest) == rest) | rest.rlike(r"\s")), _NAME)
        .when(low.isin(UNITS), _UNIT)
        .otherwise(low)
    )


def _windows(words: Column, kind: str, size: int) -> Column:
    """Array of (w, i, h): hashes of all runs of `size` words, apart by kind."""

    def one(i: Column) -> Column:
        return F.struct(F.lit(size).alias("w"), (i - 1).alias("i"), F.xxhash64(F.lit(kind), F.slice(words, i, F.lit(size))).alias("h"))

    runs = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) >= size, F.transform(runs, one)).otherwise(F.array().cast("array<struct<w:int,i:int,h:bigint>>"))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, kind, j, h, w, n): windows of benchmark items that hold PLAIN plain words, and their number n.

    item tells texts of one item_id apart. An item shorter than a window is one window of its own size. An item
    without such a window is nothing but placeholders: it keeps all its windows, of the words as they are
    (kind "word" instead of "template"), so that they don't fit every table of figures.
    """
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), tokens(F.col(text).cast("string")).alias("raw")).where("item_id IS NOT NULL")
    rows = rows.where(F.size("raw") > 0).distinct().withColumn("item", F.xxhash64("item_id", "raw"))
    rows = rows.withColumns({"template": F.transform("raw", template), "word": F.transform("raw", F.lower), "w": F.least(F.lit(WINDOW), F.size("raw"))})
    cut = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("w"))))
    plain = F.size(F.filter(F.slice("template", F.col("j") + 1, F.col("w")), lambda x: ~x.isin(_NUMBER, _NAME, _UNIT)))
    cut = cut.withColumn("plain", plain >= PLAIN)
    some = cut.groupBy("item").agg(F.max("plain").alias("some"), F.count(F.when(F.col("plain"), 1)).alias("p"), F.count("*").alias("a"))
    cut = cut.join(some, "item").where("plain OR NOT some").withColumn("kind", F.when(F.col("some"), "template").otherwise("word"))
    h = F.when(F.col("some"), F.xxhash64(F.lit("template"), F.slice("template", F.col("j") + 1, F.col("w")))).otherwise(F.xxhash64(F.lit("word"), F.slice("word", F.col("j") + 1, F.col("w"))))
    return cut.select("item", "item_id", "kind", "j", h.alias("h"), "w", F.when(F.col("some"), F.col("p")).otherwise(F.col("a")).alias("n"))


def _agree(slots: Column) -> Column:
    """Whether distinct slots (type, q, d) map one to one between question and document."""
    side = lambda x: F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["type"], s[x]))))
    return (side("q") == F.size(slots)) & (side("d") == F.size(slots))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", part: float = PART) -> DataFrame:
    """Rows (doc_id, item_id, share): documents that hold at least `part` of a benchmark item's template windows
    with consistent slots.

    Text is cut to words and numbers; numbers, units and names become typed placeholders, other words are
    lower-cased. Windows of eight are joined by hash to the items'. Matches of one document and item at one
    distance are a reading; a reading is consistent if its placeholders map one to one between the two texts, so
    a question with other numbers and names is caught, and a chance likeness is not. Readings of one item (its
    text broken by inserted words) count together as far as their slots agree, the largest first. A name that a
    document writes with further capitalised words before or after it counts as that name. Null or empty texts
    match nothing; null ids are passed over; repeated rows give one result, as do rows of one doc_id with several
    texts, each judged for itself; texts of one item_id are items of their own; empty tables give no rows; other
    columns are ignored. A passage repeated in a document counts once.

    Each text is cut and hashed in one pass. The items' windows are broadcast up to BROADCAST_WINDOWS, else joined
    by a shuffle. Numbers are those of any script.
    """
    return text_leaks(docs, benchmark, doc_id, text, part).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def text_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", part: float = PART) -> DataFrame:
    """The rows of find_leaks for each text of a doc_id, with its xxhash64, x."""
    items = C.materialize(item_windows(benchmark))
    kinds = sorted((r["kind"], r["w"]) for r in items.select("kind", "w").distinct().collect())  # at most 2 * WINDOW
    small = items.count() <= BROADCAST_WINDOWS
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).where("doc_id IS NOT NULL")
    base = base.withColumn("x", F.xxhash64("t"))
    words = base.select("doc_id", "x", tokens(F.col("t")).alias("raw"))
    words = words.select("doc_id", "x", F.transform("raw", template).alias("template"), *([F.transform("raw", F.lower).alias("word")] if any(k == "word" for k, _ in kinds) else []))
    all_windows = F.concat(*[_windows(F.col(k), k, w) for k, w in kinds]) if kinds else F.array().cast("array<struct<w:int,i:int,h:bigint>>")
    cut = words.select("doc_id", "x", F.inline(all_windows))
    own = items.select("h", "w", "item", "j", "n")
    read = cut.join(F.broadcast(own) if small else own, ["h", "w"]).groupBy("doc_id", "x", "item", (F.col("i") - F.col("j")).alias("at"))
    read = C.materialize(read.agg(F.collect_set("j").alias("js"), F.max("w").alias("w"), F.max("n").alias("n")))

    # The words themselves, of candidate documents only.
    named = C.materialize(read.select("doc_id", "x").distinct())
    few = named.count() <= C.BROADCAST_IDS
    own = base.join(F.broadcast(named) if few else named, ["doc_id", "x"], "left_semi").dropDuplicates(["doc_id", "x"]).select("doc_id", "x", tokens(F.col("t")).alias("d"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text").cast("string")).alias("q")).where("item_id IS NOT NULL").distinct()
    asked = asked.withColumn("item", F.xxhash64("item_id", "q"))
    pair = read.join(own, ["doc_id", "x"]).join(asked, "item")
    spots = F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("w") - 1))))

    def slot(p: Column) -> Column:
        q, d = F.get("q", p), F.get("d", p + F.col("at"))
        low, long = F.lower(q), F.lower(d)
        same = (template(q) == _NAME) & (F.endswith(long, F.concat(F.lit(" "), low)) | F.startswith(long, F.concat(low, F.lit(" "))))
        return F.struct(template(q).alias("type"), low.alias("q"), F.when(same, low).otherwise(long).alias("d"))

    slots = F.array_distinct(F.filter(F.transform(spots, slot), lambda s: s["type"].isin(_NUMBER, _NAME, _UNIT)))
    pair = pair.withColumn("slots", slots).where(_agree(F.col("slots")))
    reading = F.struct((-F.size("js")).alias("less"), "at", "js", "slots")
    whole = pair.groupBy("doc_id", "x", "item", "item_id").agg(F.sort_array(F.collect_list(reading)).alias("readings"), F.max("n").alias("n"))

    def join(seen: Column, r: Column) -> Column:
        both = F.array_union(seen["slots"], r["slots"])
        return F.when(_agree(both), F.struct(F.array_union(seen["js"], r["js"]).alias("js"), both.alias("slots"))).otherwise(seen)

    first = F.struct(F.get("readings", F.lit(0))["js"].alias("js"), F.get("readings", F.lit(0))["slots"].alias("slots"))
    found = F.size(F.aggregate("readings", first, join)["js"]) / F.col("n")
    return whole.select("doc_id", "x", "item_id", found.alias("share")).where(F.col("share") >= part)


def judge_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted), by find_leaks. Null ids are never contaminated."""
    leaks = find_leaks(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(leaks, "doc_id", "left")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents, with all columns. Of one doc_id's texts only contaminated ones go."""
    return C.drop_texts(docs, text_leaks(docs, benchmark).select("doc_id", "x"))
