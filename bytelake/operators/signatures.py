"""Magic signatures and header structure, as column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelake.functions import byte_at, has_bytes, latin, word_at
from bytelake.operators import catalogue


@dataclass(frozen=True)
class Signature:
    name: str
    data: bytes
    offset: int = 0
    mask: bytes | None = None
    platform: str | None = None
    confidence: float = 1.0


def _basic(line: str) -> Signature:
    name, data, offset = line.split()
    return Signature(name, bytes.fromhex(data), int(offset))


def _enhanced(line: str) -> Signature:
    name, data, offset, mask, platform, confidence = line.split()
    return Signature(name, bytes.fromhex(data), int(offset), None if mask == "-" else bytes.fromhex(mask), None if platform == "-" else platform, float(confidence))


#: Signatures of a table up to which it is broadcast, some 200 bytes each.
BROADCAST_SIGNATURES = 1 << 18
#: Bytes that are looked up by a join: the longest of these that a run of unmasked bytes holds.
PROBES = (8, 4, 2, 1)

BASIC = tuple(map(_basic, catalogue.BASIC.strip().splitlines()))
ENHANCED = tuple(map(_enhanced, catalogue.ENHANCED.strip().splitlines()))


def add_signature(signatures: tuple[Signature, ...], new: Signature) -> tuple[Signature, ...]:
    return (*signatures, new)


def match_signature(s: Signature, content: Column | str = "content") -> Column:
    """Whether all bytes are there. Where a mask has a byte other than 0, only its bits count; a 0 means all do."""
    if not s.mask or not any(s.mask):
        return has_bytes(content, s.data, s.offset)
    out = F.octet_length(content) >= s.offset + len(s.data)
    for i, b in enumerate(s.data):
        m = (s.mask[i] if i < len(s.mask) else 0) or 255
        out = out & (byte_at(content, s.offset + i).bitwiseAND(F.lit(m)) == (b & m))
    return F.coalesce(out, F.lit(False))


def signature_table(spark: SparkSession, signatures: tuple[Signature, ...] = ENHANCED) -> DataFrame:
    """sig_idx, name, data, offset, mask, platform, confidence: signatures as rows."""
    rows = [(i, s.name, bytearray(s.data), s.offset, bytearray(s.mask) if s.mask else None, s.platform, float(s.confidence)) for i, s in enumerate(signatures)]
    return spark.createDataFrame(rows, "sig_idx int, name string, data binary, offset int, mask binary, platform string, confidence double")


def add_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    """A signature table with further rows (name, data, offset, mask, platform, confidence), which come after those that
    are there, by name. new is a catalogue's addition: its rows are numbered in one task."""
    last = table.agg((F.coalesce(F.max("sig_idx"), F.lit(-1)) + 1).alias("_next"))  # one row
    place = F.row_number().over(Window.orderBy("name", "data", "offset")) - 1
    rows = new.withColumn("_place", place).join(F.broadcast(last), how="cross").withColumn("sig_idx", (F.col("_next") + F.col("_place")).cast("int"))
    return table.unionByName(rows.select(*table.columns))


def _looked_up(table: DataFrame) -> DataFrame:
    """Signatures with at, size and key: the bytes by which they are looked up, the longest of PROBES that lie in a run of
    bytes without a mask, none (size 0) where each byte has one. want and bits are arrays of the masked bytes and masks, null
    where no mask has a bit."""
    ints = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.hex(F.substring(F.col(b), i, F.lit(1))), 16, 10).cast("int"))
    rows = table.where("data IS NOT NULL AND octet_length(data) > 0 AND offset >= 0")
    used = F.when(F.octet_length("mask") > 0, F.transform(ints("data"), lambda _, i: F.when(F.coalesce(F.get(ints("mask"), i), F.lit(0)) > 0, F.get(ints("mask"), i)).otherwise(255)))
    some = F.exists(ints("mask"), lambda m: m > 0) & (F.octet_length("mask") > 0)
    rows = rows.withColumn("bits", F.when(some, used))
    rows = rows.withColumn("want", F.when(F.col("bits").isNotNull(), F.zip_with(ints("data"), "bits", lambda a, m: a.bitwiseAND(m))))
    n = F.octet_length("data")
    free = lambda k: lambda i: F.col("bits").isNull() | F.forall(F.slice("bits", i + 1, F.lit(k)), lambda m: m == 255)
    spots = [F.when(n >= k, F.get(F.filter(F.sequence(F.lit(0), n - k), free(k)), F.lit(0))) for k in PROBES]
    best = F.coalesce(*[F.when(s.isNotNull(), F.struct(s.alias("i"), F.lit(k).alias("k"))) for s, k in zip(spots, PROBES, strict=True)], F.struct(F.lit(0).alias("i"), F.lit(0).alias("k")))
    rows = rows.withColumn("b", best).withColumns({"at": F.col("offset") + F.col("b.i"), "size": F.col("b.k")})
    return rows.withColumn("key", F.substring("data", F.col("b.i") + 1, F.col("size"))).drop("b")


def match_table(blobs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of matches for a table of signatures, however many: blob_id, sig_idx, name, platform, confidence.

    Signatures are looked up by some of their bytes: a blob gives a row for each place and length at which some
    signature has its key (a few for a catalogue), with the bytes there and those that the signatures at that place
    reach to. These are joined by (place, length, bytes), by a broadcast of up to BROADCAST_SIGNATURES rows, else by a
    shuffle of these short rows; what meets is compared in full, under the mask. Content isn't moved. Signatures whose
    bytes all have a mask are compared with every blob that is long enough. Null or empty data and negative offsets match
    nothing; null content matches nothing.
    """
    rows = _looked_up(table)
    n = F.octet_length("data")
    places = rows.groupBy("at", "size").agg(F.min("offset").alias("start"), F.max(F.col("offset") + n).alias("end"), F.count("*").alias("c")).orderBy("at", "size").collect()  # a row a place
    if not places:
        return blobs.select("blob_id").limit(0).join(table.select("sig_idx", "name", "platform", "confidence").limit(0), how="cross")
    kind = "array<struct<at:int,size:int,start:int,end:int>>"
    listed = F.from_json(F.lit(json.dumps([{k: p[k] for k in ("at", "size", "start", "end")} for p in places])), kind)
    content = F.col("content")

    def probe(p: Column) -> Column:
        key = F.when(p["size"] > 0, F.substring(content, p["at"] + 1, p["size"])).otherwise(F.lit(bytearray()))
        return F.struct(p["at"].alias("at"), p["size"].alias("size"), p["start"].alias("start"), key.alias("key"), F.substring(content, p["start"] + 1, p["end"] - p["start"]).alias("seen"))

    # A key that the content is too short for is shorter, and equals none.
    probes = blobs.where("content IS NOT NULL").select("blob_id", F.inline(F.transform(listed, probe)))
    small = sum(p["c"] for p in places) <= BROADCAST_SIGNATURES
    met = probes.join(F.broadcast(rows) if small else rows, ["at", "size", "key"])
    own = F.substring("seen", F.col("offset") - F.col("start") + 1, n)
    byte = lambda i: F.conv(F.hex(F.substring(own, i, F.lit(1))), 16, 10).cast("int")
    masked = F.forall(F.sequence(F.lit(1), n), lambda i: byte(i).bitwiseAND(F.get("bits", i - 1)) == F.get("want", i - 1))
    same = F.when(F.col("bits").isNull(), own == F.col("data")).otherwise((F.octet_length(own) == n) & F.coalesce(masked, F.lit(False)))
    return met.where(same).select("blob_id", "sig_idx", "name", "platform", "confidence")


def _array(pairs: list[tuple[str, Column]], first: int = 0) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("emit_idx"), F.lit(n).alias("feature"), v.cast("double").alias("value")) for i, (n, v) in enumerate(pairs, first)])


def _rows(pairs: list[tuple[str, Column]]) -> Column:
    return F.inline_outer(_array(pairs))  # inline would make Spark compute the array twice, to filter empty ones


def signature_features(blobs: DataFrame, signatures: tuple[Signature, ...] = BASIC) -> DataFrame:
    """signature_<name> 1 or 0, and signature_match_count."""
    hits = [F.when(match_signature(s), 1).otherwise(0) for s in signatures]
    return blobs.select("blob_id", _rows([*((f"signature_{s.name}", h) for s, h in zip(signatures, hits, strict=True)), ("signature_match_count", sum(hits[1:], hits[0]))]))


def _found(signatures: tuple[Signature, ...]) -> Column:
    """Array of (sig_idx, name, platform, confidence) of the signatures that match."""
    found = F.array(*[F.when(match_signature(s), F.struct(F.lit(i).alias("sig_idx"), F.lit(s.name).alias("name"), F.lit(s.platform).alias("platform"), F.lit(s.confidence).alias("confidence"))) for i, s in enumerate(signatures)])
    return F.filter(found, lambda x: x.isNotNull())


def matches(blobs: DataFrame, signatures: tuple[Signature, ...] = ENHANCED) -> DataFrame:
    """blob_id, sig_idx, name, platform, confidence of signatures that match. Content is read once and not moved."""
    return blobs.select("blob_id", F.explode_outer(_found(signatures)).alias("m")).where("m IS NOT NULL").select("blob_id", "m.*")


def platform_scores(found: DataFrame) -> DataFrame:
    """Sum of confidences of each known platform with a match, and the least index of its signatures."""
    return found.where(F.col("platform").isin(*catalogue.PLATFORMS)).groupBy("blob_id", "platform").agg(F.sum("confidence").alias("score"), F.min("sig_idx").alias("first_idx"))


def dominant_platform(scores: DataFrame) -> DataFrame:
    """The platform with the largest score; of equal ones that matched first. code: c64 1, vic20 0, others 0.5."""
    best = scores.groupBy("blob_id").agg(F.max_by("platform", F.struct(F.round("score", 9), -F.col("first_idx"))).alias("platform"))
    return best.withColumn("code", F.when(F.col("platform") == "c64", 1.0).when(F.col("platform") == "vic20", 0.0).otherwise(0.5))


def basic_structure(content: Column | str = "content") -> tuple[Column, Column]:
    """(valid, hops) of a chain of line links from offset 2, ten at most: a link of 0 ends it, one that goes back or
    beyond the content makes it invalid. Content under 5 bytes is invalid."""
    size = F.octet_length(content)
    start = F.struct(F.lit(2).alias("pos"), F.lit(0).alias("hops"), F.lit(True).alias("ok"), F.lit(False).alias("done"))

    def hop(a: Column, _: Column) -> Column:
        stop = a["done"] | (a["pos"] >= size - 4)
        link = F.coalesce(word_at(content, a["pos"]), F.lit(0))
        bad = (link < a["pos"]) | (link >= size)
        keep = lambda done, ok: F.struct(a["pos"].alias("pos"), a["hops"].alias("hops"), ok.alias("ok"), done.alias("done"))
        go = F.struct(link.cast("int").alias("pos"), (a["hops"] + 1).alias("hops"), F.lit(True).alias("ok"), F.lit(False).alias("done"))
        return F.when(stop, keep(F.lit(True), a["ok"])).when(link == 0, keep(F.lit(True), a["ok"])).when(bad, keep(F.lit(True), F.lit(False))).otherwise(go)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, hop)
    return (size >= 5) & end["ok"] & (end["hops"] > 0), F.when(size >= 5, end["hops"]).otherwise(0)


def memory_access(address: int, content: Column | str = "content") -> Column:
    """Whether a load or store of the address, by absolute addressing, is there; the last three bytes aren't tested."""
    low, high = address & 255, address >> 8
    return latin(content).rlike(rf"(?s)[\xAD\x8D\xAE\x8E\xAC\x8C]\x{low:02X}\x{high:02X}.")


def _structure() -> list[tuple[str, Column]]:
    valid, hops = basic_structure()
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return [
        ("signature_valid_basic_structure", flag(valid, 1.0)),
        ("signature_basic_line_count", hops / F.lit(10.0)),
        ("signature_has_low_memory_access", flag(memory_access(0x0100), 0.4)),
        ("signature_has_vic_registers_access", flag(memory_access(0x9000), 0.5)),
        ("signature_has_sid_registers_access", flag(memory_access(0xD400), 0.5)),
    ]


def structure_features(blobs: DataFrame) -> DataFrame:
    return blobs.select("blob_id", _rows(_structure()))


def enhanced_array(blobs: DataFrame, name: str, signatures: tuple[Signature, ...] = ENHANCED) -> DataFrame:
    """blobs with an array column of the rows (emit_idx, feature, value) of enhanced_signature_features: signatures are
    matched once, platforms are summed inside the row."""
    hit = {i: f"{name}_hit{i}" for i in range(len(signatures))}
    blobs = blobs.withColumns({hit[i]: match_signature(s) for i, s in enumerate(signatures)})
    number, n = (lambda i, v: F.when(F.col(hit[i]), v).otherwise(0)), len(signatures)
    own = [(f"signature_{s.name}", number(i, s.confidence)) for i, s in enumerate(signatures)]
    count = sum((number(i, 1) for i in hit), F.lit(0))
    scores = []
    for j, p in enumerate(catalogue.PLATFORMS):
        of = [i for i, s in enumerate(signatures) if s.platform == p]
        if of:
            score = sum((number(i, signatures[i].confidence) for i in of), F.lit(0.0))
            first = F.coalesce(*[F.when(F.col(hit[i]), i) for i in of])
            scores.append(F.when(first.isNotNull(), F.struct(F.round(score, 9).alias("score"), (-first).alias("order"), F.lit(p).alias("platform"), score.alias("sum"), F.lit(j + n + 1).alias("emit_idx"))))
    found = f"{name}_scores"
    blobs = blobs.withColumn(found, F.array_compact(F.array(*scores)))
    per = F.transform(F.col(found), lambda r: F.struct(r["emit_idx"], F.concat(F.lit("signature_platform_"), r["platform"]).alias("feature"), r["sum"].alias("value")))
    top = F.array_max(found)["platform"]
    code = F.when(top == "c64", 1.0).when(top == "vic20", 0.0).otherwise(0.5)
    best = F.when(F.size(found) > 0, _array([("signature_dominant_platform", code)], n + 9)).otherwise(F.array().cast("array<struct<emit_idx:int,feature:string,value:double>>"))
    return blobs.withColumn(name, F.concat(_array([*own, ("signature_match_count", count)]), per, best, _array(_structure(), n + 10))).drop(*hit.values(), found)


def enhanced_signature_features(blobs: DataFrame, signatures: tuple[Signature, ...] = ENHANCED) -> DataFrame:
    """signature_<name> (confidence or 0), signature_match_count, the platforms' sums, the dominant platform's code
    and the header's structure. One pass over content, no shuffle."""
    return enhanced_array(blobs, "_rows", signatures).select("blob_id", F.inline_outer("_rows"))


enhanced_signature_features.array = enhanced_array
enhanced_signature_features.prefixes = ("signature_",)


def load_address_array(blobs: DataFrame, name: str) -> DataFrame:
    """blobs with an array column of the rows (emit_idx, feature, value) of load_address_features."""
    word, size = word_at("content", 0), F.octet_length("content")
    near = lambda known: 1 - F.array_min(F.array(*[F.abs(word - k) / F.lit(65536.0) for k in known]))
    c, v = near(catalogue.C64_ADDRESSES), near(catalogue.VIC20_ADDRESSES)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    short = size < 2
    link = word_at("content", 2)
    pairs = [
        ("value", F.when(short, 0.0).otherwise(word / F.lit(65536.0)), None),
        ("is_c64", flag(~short & word.isin(*catalogue.C64_ADDRESSES)), None),
        ("is_vic20", flag(~short & word.isin(*catalogue.VIC20_ADDRESSES)), None),
        ("c64_similarity", F.when(short, 0.0).otherwise(c), None),
        ("vic20_similarity", F.when(short, 0.0).otherwise(v), None),
        ("platform_ratio", F.when(short, 0.5).otherwise((c - v + 1) / 2), None),
        ("has_valid_basic_link", flag((link > 4) & (link < size)), 6),
        ("has_basic_token", flag(byte_at("content", 6).isin(0x9E, 0x8F, 0x99)), 7),
    ]
    items = [F.struct(F.lit(i).alias("emit_idx"), F.lit(f"load_addr_{n}").alias("feature"), x.alias("value")) for i, (n, x, _) in enumerate(pairs)]
    rows = F.filter(F.array(*[F.when(size >= least, s) if least else s for s, (_, _, least) in zip(items, pairs, strict=True)]), lambda s: s.isNotNull())
    return blobs.withColumn(name, rows)


def load_address_features(blobs: DataFrame) -> DataFrame:
    """Load address by 65536, whether and how nearly it is a known one of either platform, the platforms' ratio and,
    for blobs long enough, a valid first link and a first token. Blobs under 2 bytes have defaults."""
    return load_address_array(blobs, "_rows").select("blob_id", F.inline_outer("_rows"))


load_address_features.array = load_address_array
load_address_features.prefixes = ("load_addr_",)


def signature_report(found: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Matches by the first part of their names: number and largest confidence, for each blob, and for all (prefix
    total). With blobs, also rows for their structure's values: the feature as prefix, the value as best."""
    prefix = F.element_at(F.split("name", "_"), 1)
    rows = found.withColumn("prefix", prefix)
    sums = (F.count("*").alias("matched"), F.max("confidence").alias("best"))
    out = rows.groupBy("blob_id", "prefix").agg(*sums).unionByName(rows.groupBy("blob_id").agg(*sums).withColumn("prefix", F.lit("total")))
    if blobs is not None:
        out = out.unionByName(structure_features(blobs).select("blob_id", F.col("feature").alias("prefix"), F.lit(None).cast("long").alias("matched"), F.col("value").alias("best")))
    return out


def judged_platforms(blobs: DataFrame, signatures: tuple[Signature, ...] = ENHANCED) -> DataFrame:
    """blob_id, label, platform, correct: the dominant platform or, without one, the first part of the name of the
    surest signature that matched (of equal ones the first) where that is a platform; correct if it is the label."""
    found = matches(blobs, signatures)
    best = dominant_platform(platform_scores(found)).select("blob_id", "platform")
    first = F.element_at(F.split("name", "_"), 1)
    other = found.groupBy("blob_id").agg(F.max_by(first, F.struct("confidence", -F.col("sig_idx"))).alias("named"))
    other = other.where(F.col("named").isin(*catalogue.PLATFORMS))
    rows = blobs.select("blob_id", "label").join(best, "blob_id", "left").join(other, "blob_id", "left").withColumn("platform", F.coalesce("platform", "named"))
    return rows.select("blob_id", "label", "platform", F.coalesce(F.col("label") == F.col("platform"), F.lit(False)).alias("correct"))


def misclassified(blobs: DataFrame, signatures: tuple[Signature, ...] = ENHANCED) -> DataFrame:
    """blob_id, label, platform of blobs whose platform isn't their label."""
    return judged_platforms(blobs, signatures).where("NOT correct").drop("correct")


def signature_accuracy(blobs: DataFrame, signatures: tuple[Signature, ...] = ENHANCED) -> DataFrame:
    """For each label, and for all (label null): blobs, correct ones and accuracy of judged_platforms."""
    judged = judged_platforms(blobs, signatures).withColumn("right", F.col("correct").cast("int"))
    return judged.rollup("label").agg(F.count("*").alias("total"), F.sum("right").alias("correct"), (F.sum("right") / F.count("*")).alias("accuracy"))
