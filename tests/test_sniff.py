"""BASIC, stubs, cartridges and instruction tables on literal bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.operators import machine, sniff
from tests.test_operators import blobs

PRINT = bytes.fromhex("01100510000099000000")
STUB = bytes.fromhex("01080b080a009e32303631000000a900e8e8e8e8e860")


def program(lines, base=0x1001):
    out, at = bytearray(base.to_bytes(2, "little")), base
    for number, body in lines:
        at += len(body) + 5
        out += at.to_bytes(2, "little") + number.to_bytes(2, "little") + body + b"\0"
    return bytes(out + b"\0\0")


def test_decoding():
    assert sniff.decode_basic(PRINT) == [(0x1001, 0, " PRINT", 6, "line")]
    rows = sniff.decode_basic(program([(10, b'\x99"AB\x99"'), (20, b"\x81I\xb21\xa43")]) + b"xyz")
    assert [r[:3] for r in rows] == [(0x1001, 10, ' PRINT"ab{99}"'), (0x100C, 20, " FORi=1TO3"), (0x101B, None, "3 trailing bytes")]
    for bad in (b"", b"short", bytes.fromhex("01100000000000000000")):
        with pytest.raises(ValueError):
            sniff.decode_basic(bad)


def test_basic_scores():
    assert sniff.basic_score(PRINT, 1.8) == 11.25
    assert sniff.basic_score(program([(10, b"\x99"), (9, b"\x99"), (9, b"\x99")]), 1.8) == pytest.approx(1.8 * 6.25 * 0.25**2)
    assert sniff.basic_score(b"nothing like a program", 0.2) == 0.2  # runs off the end without a line
    assert sniff.basic_score(b"short", 1.8) == 0.01


def test_walks():
    assert 3 * sniff.stub_factors(STUB) == 192
    assert sniff.walk(bytes.fromhex("00104C041000EA00"), 0x1000) == 3
    assert sniff.walk(bytes.fromhex("0010B0034C0610EA00"), 0x1000) <= 6
    with pytest.raises(ValueError):
        sniff.walk(b"\xff\xff" + bytes(10), 0xFFFF)


def test_file_types(spark):
    cart = bytes(6) + sniff.VIC_CART
    some = blobs(spark, [PRINT, STUB, cart, b"plain text, nothing else", b"", sniff.CRT + bytes(8)])
    scores = sniff.sniffer_scores(some)
    assert scores.where("blob_id = 'b0'").count() == 22
    assert scores.where("blob_id = 'b1' AND sniffer = 'stub c64'").first().score == 192
    got = {r.blob_id: (r.type, r.sniffer) for r in sniff.classify_type(scores).collect()}
    assert got["b0"] == ("basic", "unexpanded") and got["b1"] == ("code", "stub c64") and got["b2"] == ("code", "vic20 cart") and got["b4"] == ("unknown", "unknown")
    lines = sniff.basic_lines(some)
    assert {r.blob_id: r.lines for r in sniff.basic_line_count(lines).collect()}["b0"] == 1
    assert {r.blob_id for r in lines.where("kind = 'error'").collect()} >= {"b4"}


def test_opcodes_and_sweep(spark):
    ops = machine.opcodes()
    assert len(ops) == 151 and [ops[k][0] for k in (0xEA, 0x48, 0xE8, 0x69)] == ["NOP", "PHA", "INX", "ADD"]
    assert swept("00104C0265") == [(0x1000, 2, 3, 0x4C, 0x6502)]
    some = blobs(spark, [bytes.fromhex("0010D0FE8D0090AD0010604C0510")])
    table = machine.instruction_table(some)
    targets = machine.operand_targets(table)
    assert {r.mnemonic: r.target for r in targets.collect()} == {"BNE": 0x1000, "STA": 0x9000, "LDA": 0x1000, "RTS": None, "JMP": 0x1005}
    assert {(r.mnemonic, r.target) for r in machine.jump_targets(targets, some).collect()} == {("BNE", 0x1000), ("JMP", 0x1005)}
    refs = machine.static_memory_refs(targets, some).first()
    assert (refs.addresses_read, refs.addresses_written, refs.addresses_inside) == (1, 1, 1)
    use = machine.symbol_usage(targets, spark.createDataFrame([(0x9000, "VICCR0")], "addr int, name string")).first()
    assert (use.name, use.uses, use.blobs) == ("VICCR0", 1, 1)
    mix = machine.instruction_mix(table)
    assert mix.where(F.col("category").isNull()).first()["rows"] == 5


def swept(raw, entries=(), data=()):
    got = machine.sweep(bytes.fromhex(raw), machine.sizes_table(), np.array(sorted(entries), np.int64), data)
    return list(zip(*(got[c].tolist() for c in ("addr", "offset", "len", "opcode", "operand")), strict=True))


def test_sweep_of_odd_content():
    assert swept("") == swept("0010") == []
    assert swept("00100203") == [(0x1000, 2, 2, -1, -1)]  # a run without opcodes
    assert swept("00104C02") == [(0x1000, 2, 1, -1, -1), (0x1001, 3, 1, -1, -1)]  # no room for the operand
    assert swept("0010EA4C0001EA", {0x1003}) == [(0x1000, 2, 1, 0xEA, -1), (0x1001, 3, 1, -1, -1), (0x1002, 4, 1, 0x00, -1), (0x1003, 5, 2, 0x01, 0xEA)]
    assert swept("00100202EA02", {0x1001}) == [(0x1000, 2, 1, -1, -1), (0x1001, 3, 1, -1, -1), (0x1002, 4, 1, 0xEA, -1), (0x1003, 5, 1, -1, -1)]
    assert swept("0010EAEAEAEA", data=((0x1001, 0x1003),)) == [(0x1000, 2, 1, 0xEA, -1), (0x1001, 3, 2, -1, -1), (0x1003, 5, 1, 0xEA, -1)]
    assert swept("00104CEAEAEA", data=((0x1002, 0x1003),))[0] == (0x1000, 2, 1, -1, -1)  # a span cuts it short


def test_sweep_step_by_step():
    """Against a walk from byte to byte."""
    rng, sizes = np.random.default_rng(1), machine.sizes_table()
    for _ in range(200):
        raw = bytes(rng.integers(0, 256, rng.integers(0, 90), dtype=np.uint8))
        want, i = [], 2
        while i < len(raw):
            n = int(sizes[raw[i]])
            if n and i + n <= len(raw):
                want.append((i, n, True))
            else:
                j = i + 1
                while not n and j < len(raw) and not sizes[raw[j]]:
                    j += 1
                want.append((i, j - i, False))
            i += want[-1][1]
        assert [(o, n, k >= 0) for _, o, n, k, _ in swept(raw.hex())] == want


def test_scores_decode_a_program_once_and_make_text_at_line_ends_only(monkeypatch):
    decoded, texts, decode, text = [], [], sniff.decode_basic, sniff._text
    monkeypatch.setattr(sniff, "decode_basic", lambda raw: decoded.append(raw) or decode(raw))
    monkeypatch.setattr(sniff, "_text", lambda spans, quoted: texts.append(spans) or text(spans, quoted))
    line = b'\x01\x08\x10\x08\x0a\x00\x99"\x99a":\x81for\x00\x00\x00'
    for raw, lines in ((b"<!DOCTYPE html>" * 200, 0), (line, 1), (line + b"rest", 1)):
        decoded.clear(), texts.clear()
        both = sniff.basic_scores(raw, (1.8, 0.2))
        assert len(decoded) == 1 and len(texts) == lines
        assert both == [sniff.basic_score(raw, 1.8), sniff.basic_score(raw, 0.2)]
    assert [r[1:3] for r in decode(line)] == [(10, ' PRINT"{99}{61}":FOR{66}{6f}{72}')]
