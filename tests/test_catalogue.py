"""Signatures and symbols as tables, and declared spans of each blob."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.operators import machine, signatures, symbols
from bytelake.sources import blobs_from_column

RNG = np.random.default_rng(9)


def of(spark, raws):
    return blobs_from_column(spark.createDataFrame([(str(i), bytearray(r) if r is not None else None) for i, r in enumerate(raws)], "id string, b binary"), "id", "b")


def found(df):
    return sorted((r.blob_id, r.sig_idx, r.name, r.platform, r.confidence) for r in df.collect())


def test_the_catalogue_as_a_table(spark):
    """The same rows as by expressions."""
    raws = [s.data.rjust(s.offset + len(s.data), b"\x05") + b"\x00" * k for s in signatures.ENHANCED for k in (0, 3)] + [b"", b"\x01", bytes(80), b"\xc5\x00\x00\x00", b"\xcf\x00\x00\x00\x01", b"C64", bytes(15) + b"\x01\x96"]
    blobs = of(spark, raws)
    assert found(signatures.match_table(blobs, signatures.signature_table(spark))) == found(signatures.matches(blobs))
    assert len(found(signatures.matches(blobs))) > 100


@pytest.mark.parametrize("most", [1 << 18, 10])
def test_5000_signatures(spark, monkeypatch, most):
    """Masked and plain ones at any place, against comparison byte by byte; by a broadcast and by a shuffle."""
    monkeypatch.setattr(signatures, "BROADCAST_SIGNATURES", most)
    raws = [RNG.integers(0, 4, int(n), np.uint8).tobytes() for n in RNG.integers(0, 60, 40)]
    own = []
    for i in range(5000):
        data = RNG.integers(0, 4, int(RNG.integers(1, 12)), np.uint8).tobytes()
        mask = RNG.choice([0, 1, 2, 255], len(data) + int(RNG.integers(-1, 2))).astype(np.uint8).tobytes() if i % 3 == 0 else None
        own.append(signatures.Signature(f"s{i}", data, int(RNG.integers(0, 6)), mask, "c64" if i % 2 else None, i / 5000))

    def fits(s, raw):
        bits = [m or 255 for m in s.mask.ljust(len(s.data), b"\0")] if s.mask and any(s.mask) else [255] * len(s.data)
        part = raw[s.offset : s.offset + len(s.data)]
        return len(part) == len(s.data) and all(a & m == b & m for a, b, m in zip(part, s.data, bits, strict=False))

    want = sorted((str(k), i, s.name, s.platform, s.confidence) for k, raw in enumerate(raws) for i, s in enumerate(own) if fits(s, raw))
    got = found(signatures.match_table(of(spark, raws), signatures.signature_table(spark, tuple(own))))
    assert got == want and len(want) > 1000
    few = tuple(own[:60])
    assert found(signatures.matches(of(spark, raws), few)) == [w for w in want if w[1] < 60]


def test_signatures_added_as_rows(spark):
    base = signatures.signature_table(spark, signatures.BASIC)
    new = spark.createDataFrame([("mine", bytearray(b"\x08\x01"), 1, None, "c64", 0.5), ("null", None, 0, None, None, 0.5), ("neg", bytearray(b"\x01"), -1, None, None, 0.5), ("all", bytearray(b"\x81"), 0, bytearray(b"\x0f"), None, 0.1)], "name string, data binary, offset int, mask binary, platform string, confidence double")
    both = signatures.add_rows(base, new)
    assert [r.sig_idx for r in both.orderBy("sig_idx").collect()] == list(range(len(signatures.BASIC) + 4))
    got = {(r.blob_id, r.name) for r in signatures.match_table(of(spark, [b"\x01\x08\x01", None, b"", b"\x78"]), both).collect()}
    assert got == {("0", "c64_prg"), ("0", "mine"), ("0", "all"), ("3", "assembly_sei_start")}
    assert signatures.match_table(of(spark, [b"\x01"]), base.limit(0)).count() == 0
    assert signatures.match_table(of(spark, [b"\x01"]).limit(0), base).count() == 0


def test_spans_of_each_blob(spark, monkeypatch):
    raws = [b"\x00\x10" + RNG.integers(0, 256, 50, np.uint8).tobytes() for _ in range(12)]
    blobs = of(spark, raws)
    rows = [(str(i), "entry", 0x1000 + 3 * i, None) for i in range(9)] + [(str(i), "data", 0x1000 + 10 + i, 0x1000 + 20 + i) for i in range(6)]
    odd = [(None, "data", 1, 2), ("1", "data", 9, 9), ("1", "other", 1, 2), ("99", "entry", 1, None), ("2", "entry", None, None)]
    spans = spark.createDataFrame(rows + rows[:3] + odd, "blob_id string, kind string, start long, end long")
    want = []
    for i, raw in enumerate(raws):
        s = machine.sweep(raw, machine.sizes_table(), np.array(sorted(r[2] for r in rows if r[0] == str(i) and r[1] == "entry"), np.int64), tuple((r[2], r[3]) for r in rows if r[0] == str(i) and r[1] == "data"))
        want += [(str(i), *x) for x in zip(*(s[c].tolist() for c in ("addr", "offset", "len")), strict=True)]
    for most in (1 << 18, 0):
        monkeypatch.setattr(machine, "BROADCAST_SPANS", most)
        table = machine.instruction_table(machine.with_spans(blobs, spans))
        assert sorted((r.blob_id, r.addr, r.offset, r.len) for r in table.collect()) == sorted(want)
    assert machine.with_spans(blobs, spans.limit(0)).where("size(entries) + size(data) > 0").count() == 0
    assert machine.instruction_table(machine.with_spans(blobs.limit(0), spans)).count() == 0


def test_symbols_of_both_systems(spark):
    rows = symbols.rows()
    assert len({(s, a, z) for s, a, z, *_ in rows}) == len(rows) and len({(s, n, k) for s, _, _, n, k, _ in rows}) == len(rows)
    at = {(r.system, r.target): r.name for r in symbols.addressed(symbols.system_symbols(spark)).collect()}
    assert at["c64", 0xFFD2] == "chrout" and at["vic20", 0xFFD2] == "ichrout" and at["vic20", 0xFD57] == "_vector"
    assert at["vic20", 0x9005] == "VICCR5" and at["vic20", 0x9115] == "via1" and at["vic20", 0x9600] == "color_ram" and at["c64", 0xD418] == "sid"
    assert at["vic20", 0x033C] == "TPHDRID" and at["vic20", 0x0350] == "tape_buffer" and ("c64", 0x3000) not in at


def test_smaller_areas_stand_before_larger_ones(spark):
    own = spark.createDataFrame([(0, 65535, "all"), (10, 20, "b"), (12, 14, "a"), (13, None, "one"), (None, 3, "no"), (70000, 70001, "far"), (30, 20, "back"), (40, 41, "y"), (40, 41, "x")], "addr int, last int, name string")
    at = {r.target: r.name for r in symbols.addressed(own).collect()}
    assert len(at) == 65536 and [at[i] for i in (9, 10, 12, 13, 14, 15, 20, 21, 25, 40)] == ["all", "b", "a", "one", "a", "b", "b", "all", "all", "x"]
