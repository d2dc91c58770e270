"""Instruction tables: a linear sweep over machine code, and what the corpus's instructions refer to."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from bytelake.operators.grams import ROWS, content_of
from bytelake.operators.symbols import addressed, system_symbols

# The processor's instructions. Mnemonic, category, semantics (names of one letter, see SEMANTICS; -
# none), then opcodes by addressing mode.
INSTRUCTIONS = """
ADD arith - immediate 69 zeropage 65 zeropage_x 75 absolute 6d absolute_x 7d absolute_y 79 indirect_x 61 indirect_y 71
AND lg - immediate 29 zeropage 25 zeropage_x 35 absolute 2d absolute_x 3d absolute_y 39 indirect_x 21 indirect_y 31
ASL arith - accumulator 0a zeropage 06 zeropage_x 16 absolute 0e absolute_x 1e
BCC br c relative 90
BCS br c relative b0
BEQ br c relative f0
BIT lg - zeropage 24 absolute 2c
BMI br c relative 30
BNE br c relative d0
BPL br c relative 10
BRK fl b implied 00
BVC br c relative 50
BVS br c relative 70
CLC arith - implied 18
CLD sr - implied d8
CLI int - implied 58
CLV sr - implied b8
CMP lg - immediate c9 zeropage c5 zeropage_x d5 absolute cd absolute_x dd absolute_y d9 indirect_x c1 indirect_y d1
CPX lg - immediate e0 zeropage e4 absolute ec
CPY lg - immediate c0 zeropage c4 absolute cc
DEC arith wr zeropage c6 zeropage_x d6 absolute ce absolute_x de
DEX arith - implied ca
DEY arith - implied 88
EOR lg - immediate 49 zeropage 45 zeropage_x 55 absolute 4d absolute_x 5d absolute_y 59 indirect_x 41 indirect_y 51
INC arith wr zeropage e6 zeropage_x f6 absolute ee absolute_x fe
INX arith - implied e8
INY arith - implied c8
JMP br j absolute 4c indirect 6c
JSR sub js absolute 20
LDA mem r immediate a9 zeropage a5 zeropage_x b5 absolute ad absolute_x bd absolute_y b9 indirect_x a1 indirect_y b1
LDX mem r immediate a2 zeropage a6 zeropage_y b6 absolute ae absolute_y be
LDY mem r immediate a0 zeropage a4 zeropage_x b4 absolute ac absolute_x bc
LSR arith - accumulator 4a zeropage 46 zeropage_x 56 absolute 4e absolute_x 5e
NOP ms - implied ea
ORA lg - immediate 09 zeropage 05 zeropage_x 15 absolute 0d absolute_x 1d absolute_y 19 indirect_x 01 indirect_y 11
PHA st w implied 48
PHP st w implied 08
PLA st r implied 68
PLP st r implied 28
ROL arith - accumulator 2a zeropage 26 zeropage_x 36 absolute 2e absolute_x 3e
ROR arith - accumulator 6a zeropage 66 zeropage_x 76 absolute 6e absolute_x 7e
RTI int t implied 40
RTS sub t implied 60
SBC arith - immediate e9 zeropage e5 zeropage_x f5 absolute ed absolute_x fd absolute_y f9 indirect_x e1 indirect_y f1
SEC sr - implied 38
SED sr - implied f8
SEI int - implied 78
STA mem w zeropage 85 zeropage_x 95 absolute 8d absolute_x 9d absolute_y 99 indirect_x 81 indirect_y 91
STX mem w zeropage 86 zeropage_y 96 absolute 8e
STY mem w zeropage 84 zeropage_x 94 absolute 8c
TAX tr - implied aa
TAY tr - implied a8
TSX tr - implied ba
TXA tr - implied 8a
TXS tr - implied 9a
TYA tr - implied 98
"""
SEMANTICS = {"r": "memory_read", "w": "memory_write", "c": "conditional_jump", "j": "unconditional_jump", "s": "returnable_jump", "t": "return", "b": "break"}
STATIC = ("relative", "absolute", "immediate", "zeropage")


def _bytes(mode: str) -> int:
    return 3 if mode.startswith("absolute") or mode == "indirect" else 1 if mode in ("implied", "accumulator") else 2


@functools.cache
def opcodes() -> dict[int, tuple[str, str, int, str, list[str]]]:
    """opcode -> mnemonic, mode, bytes, category, semantics."""
    found = {}
    for line in INSTRUCTIONS.strip().splitlines():
        name, category, flags, *modes = line.split()
        for mode, code in zip(modes[::2], modes[1::2], strict=True):
            found[int(code, 16)] = (name, mode, _bytes(mode), category, [SEMANTICS[f] for f in flags if f != "-"])
    return found


def opcode_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in sorted(opcodes().items())]
    return spark.createDataFrame(rows, "opcode int, mnemonic string, mode string, bytes int, category string, semantics array<string>")


def sizes_table() -> np.ndarray:
    """Bytes of the instruction that each opcode begins; 0 for others."""
    out = np.zeros(256, np.int64)
    for k, v in opcodes().items():
        out[k] = v[2]
    return out


def sweep(raw: bytes | np.ndarray, sizes: np.ndarray, entries: np.ndarray, data: tuple[tuple[int, int], ...] = ()) -> dict[str, np.ndarray]:
    """offset, addr, len, opcode and operand (-1 for data) of a linear sweep from offset 2 on, the base being the word
    at 0.

    A legal opcode is an instruction; a run of other bytes is one data row; an instruction that doesn't fit, or that
    a declared entry address (sorted) or data span [from, to) cuts short, is one data byte. Of an instruction only the
    last byte is looked at for entries. Each byte's successor is computed at once; those reached from offset 2 are
    found by doubling the steps taken.
    """
    n = len(raw)
    if n <= 2:
        none = np.empty(0, np.int64)
        return {c: none for c in ("offset", "addr", "len", "opcode", "operand")}
    b, at = np.frombuffer(raw, np.uint8).astype(np.int64), np.arange(n)
    addr, size = (b[0] | b[1] << 8) + at - 2, sizes[b]
    entry, inside, edge = np.isin(addr, entries), np.zeros(n, bool), np.zeros(n, bool)
    for a, z in data:
        inside |= (addr >= a) & (addr < z)
        edge |= (addr == a) | (addr == z)
    size[inside] = 0
    last = np.minimum(at + size - 1, n - 1)
    code = (size > 0) & (at + size <= n) & ~((size > 1) & entry[last]) & ~inside[last]
    stops = np.flatnonzero((size > 0) | entry | edge)
    after = np.append(stops, n)[np.searchsorted(stops, at, side="right")]
    step = np.append(np.where(code, at + size, np.where(size > 0, at + 1, after)), n)
    seen, jump = np.array([2]), step
    while True:
        new = np.union1d(seen, jump[seen])
        if len(new) == len(seen):
            break
        seen, jump = new, jump[jump]
    seen = seen[seen < n]
    own = code[seen]
    low, high = b[np.minimum(seen + 1, n - 1)], b[np.minimum(seen + 2, n - 1)]
    operand = np.where(own & (size[seen] > 1), low | np.where(size[seen] > 2, high << 8, 0), -1)
    return {"offset": seen, "addr": addr[seen], "len": step[seen] - seen, "opcode": np.where(own, b[seen], -1), "operand": operand}


#: Declared entries and data spans up to which they are broadcast.
BROADCAST_SPANS = 1 << 18


def with_spans(blobs: DataFrame, spans: DataFrame) -> DataFrame:
    """blobs with columns entries (array of addresses) and data (array of spans, start and end, the end left out) from
    spans(blob_id, kind, start, end), kind "entry" or "data". Blobs without spans have empty arrays.

    Up to BROADCAST_SPANS spans are broadcast and content stays where it is; more need a join that moves it once, for which a
    table of blobs bucketed by blob_id is best. A null blob_id, start or kind is passed over, as are spans without an
    end after their start."""
    kept = spans.where("blob_id IS NOT NULL AND start IS NOT NULL AND (kind = 'entry' OR kind = 'data' AND end > start)")
    own = kept.groupBy(F.col("blob_id").alias("_of")).agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "entry", F.col("start").cast("int")))).alias("entries"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "data", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))))).alias("data"),
    )
    small = kept.count() <= BROADCAST_SPANS
    out = blobs.join(F.broadcast(own) if small else own, F.col("blob_id") == F.col("_of"), "left").drop("_of")
    return out.withColumns({"entries": F.coalesce("entries", F.array().cast("array<int>")), "data": F.coalesce("data", F.array().cast("array<struct<start:int,end:int>>"))})


def instruction_table(blobs: DataFrame, entries: frozenset[int] = frozenset(), data: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """blob_id, addr, offset, len, opcode, operand, kind by a linear sweep of each blob (see sweep); no shuffle.

    Columns entries and data of blobs (see with_spans) hold a blob's own addresses and spans, beside those of the
    parameters, which hold for all. Rows are sent back some ROWS at a time, however many blobs a batch holds."""
    sizes, own = sizes_table(), [c for c in ("entries", "data") if c in blobs.columns]

    def send(rb: pa.RecordBatch, of: list[int], found: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        col = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        blob = rb.column(0).take(pa.array(np.repeat(of, [len(f["offset"]) for f in found])))
        maybe = lambda c: pa.array(col[c].astype(np.int32), mask=col[c] < 0)
        kind = pa.array(["data", "code"]).take(pa.array((col["opcode"] >= 0).astype(np.int8)))
        out = pa.RecordBatch.from_arrays(
            [blob, *(pa.array(col[c].astype(np.int32)) for c in ("addr", "offset", "len")), maybe("opcode"), maybe("operand"), kind],
            ["blob_id", "addr", "offset", "len", "opcode", "operand", "kind"],
        )
        yield from (out.slice(at, ROWS) for at in range(0, out.num_rows, ROWS))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            of, found, rows = [], [], 0
            for i, b in enumerate(content_of(rb)):
                given = {c: rb.column(2 + k)[i].as_py() or () for k, c in enumerate(own)}
                marks = sorted(entries | {x for x in given.get("entries", ()) if x is not None})
                spans = (*data, *((s["start"], s["end"]) for s in given.get("data", ())))
                of.append(i)
                found.append(sweep(b, sizes, np.array(marks, np.int64), spans))
                rows += len(found[-1]["offset"])
                if rows >= ROWS:
                    yield from send(rb, of, found)
                    of, found, rows = [], [], 0
            if found:
                yield from send(rb, of, found)

    return blobs.select("blob_id", "content", *own).mapInArrow(go, "blob_id string, addr int, offset int, len int, opcode int, operand int, kind string")


class Instructions:
    """The table function instruction_table(content): its rows without blob_id, for SQL's LATERAL."""

    def __init__(self) -> None:
        self.sizes, self.none = sizes_table(), np.empty(0, np.int64)

    def eval(self, content: bytes) -> Iterator[tuple]:
        found = sweep(content or b"", self.sizes, self.none)
        for offset, addr, size, opcode, operand in zip(*(found[c].tolist() for c in ("offset", "addr", "len", "opcode", "operand")), strict=True):
            yield addr, offset, size, opcode if opcode >= 0 else None, operand if operand >= 0 else None, "code" if opcode >= 0 else "data"


def register(spark: SparkSession, name: str = "instruction_table") -> None:
    """Make the table function known to the session's SQL: SELECT ... FROM blobs, LATERAL instruction_table(content)."""
    spark.udtf.register(name, udtf(Instructions, returnType="addr int, offset int, len int, opcode int, operand int, kind string"))


def operand_targets(table: DataFrame) -> DataFrame:
    """Instructions with their dimension and target: the operand, or for relative ones the next address plus the
    signed byte. Null for modes that aren't static."""
    rows = table.where("kind = 'code'").join(F.broadcast(opcode_dim(table.sparkSession)), "opcode")  # 151 rows
    signed = F.when(F.col("operand") > 127, F.col("operand") - 256).otherwise(F.col("operand"))
    target = F.when(F.col("mode") == "relative", F.col("addr") + F.col("len") + signed).when(F.col("mode").isin(*STATIC), F.col("operand"))
    return rows.withColumn("target", target)


def _inside(targets: DataFrame, blobs: DataFrame) -> DataFrame:
    from bytelake.functions import word_at

    span = blobs.select("blob_id", word_at("content", 0).alias("base"), (word_at("content", 0) + F.octet_length("content") - 2).alias("end"))
    return targets.join(span, "blob_id").withColumn("inside", (F.col("target") >= F.col("base")) & (F.col("target") < F.col("end")))


def jump_targets(targets: DataFrame, blobs: DataFrame) -> DataFrame:
    """Destinations, inside the loaded range, of jumps that are known without running."""
    jumps = targets.where(F.arrays_overlap("semantics", F.array(F.lit("conditional_jump"), F.lit("unconditional_jump"))) & F.col("target").isNotNull())
    return _inside(jumps, blobs).where("inside").select("blob_id", "addr", "mnemonic", "target").distinct()


def instruction_mix(table: DataFrame) -> DataFrame:
    """Rows by blob, category and mnemonic, with totals by category and by blob (nulls), and data rows."""
    dim = F.broadcast(opcode_dim(table.sparkSession).select("opcode", "mnemonic", "category"))
    rows = table.join(dim, "opcode", "left").withColumns({"category": F.coalesce("category", "kind"), "mnemonic": F.coalesce("mnemonic", "kind")})
    return rows.rollup("blob_id", "category", "mnemonic").agg(F.count("*").alias("rows")).where("blob_id IS NOT NULL")


def static_memory_refs(targets: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct addresses read and written by static operands, but for the stack and immediates, and how many lie in the blob."""
    rows = targets.where(~F.col("mode").isin("immediate", "relative") & (F.col("category") != "st") & F.col("target").isNotNull())
    rows = _inside(rows, blobs)
    read, write = F.array_contains("semantics", "memory_read"), F.array_contains("semantics", "memory_write")
    return rows.where(read | write).groupBy("blob_id").agg(
        F.count_distinct(F.when(read, F.col("target"))).alias("addresses_read"),
        F.count_distinct(F.when(write, F.col("target"))).alias("addresses_written"),
        F.count_distinct(F.when(F.col("inside"), F.col("target"))).alias("addresses_inside"),
    )


def symbol_usage(targets: DataFrame, symbols: DataFrame | None = None, by_blob: bool = False) -> DataFrame:
    """system, name, kind, description, uses and blobs: what operands refer to, by a table of symbols (see symbols.addressed;
    else the built-in ones of both systems). Each operand counts for the symbol at its address or else for the smallest
    area around it, in each system. by_blob, the uses in each blob instead.

    The symbols of all addresses are broadcast, at most 65,536 rows a system."""
    symbols = system_symbols(targets.sparkSession) if symbols is None else symbols
    used = targets.where("mode != 'immediate'").select("blob_id", "target").join(F.broadcast(addressed(symbols)), "target")
    keys = ["system", "name", "kind", "description"]
    if by_blob:
        return used.groupBy("blob_id", *keys).agg(F.count("*").alias("uses"))
    return used.groupBy("blob_id", *keys).agg(F.count("*").alias("uses")).groupBy(*keys).agg(F.sum("uses").alias("uses"), F.count("*").alias("blobs"))
