"""System symbols: what addresses of two systems are, by exact address and by mapped area."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Address and name of the c64's system entry points.
C64_ROUTINES = """
ffa5 acptr ffc6 chkin ffc9 chkout ffcf chrin ffd2 chrout ffa8 ciout ff81 lint ffe7 clall ffc3 close ffcc clrchn
ffe4 getin fff3 iobase ff84 ioinit ffb1 listen ffd5 load ff9c membot ff99 memtop ffc0 open fff0 plot ff87 ramtas
ffde rdtim ffb7 readst ff8a restor ffd8 save ff9f scnkey ffed screen ff93 second ffba setlfs ff90 setmsg ffbd setnam
ffdb settim ffa2 settmo ffe1 stop ffb4 talk ff96 tksa ffea udtim ffae unlsn ffab untlk ff8d vector
"""
# Address and name of the vic20's entry points, then of the routines that they jump to, and others.
VIC20_ROUTINES = """
ff8a restor ff8d vector ff90 setmsg ff93 secnd ff96 tksa ff99 memtop ff9c membot ff9f scnkey ffa2 settmo ffa5 acptr
ffa8 ciout ffab untalk ffae unlsn ffb1 listn ffb4 talk ffb7 readss ffba setlfs ffbd setnam ffc0 iopen ffc3 iclose
ffc6 ichkin ffc9 ichkout ffcc iclrch ffcf ichrin ffd2 ichrout ffd5 load ffd8 save ffdb settim ffde rdtim ffe1 istop
ffe4 igetin ffe7 iclall ffea udtim ffed screen fff0 plot fff3 iobase
fd57 _vector fe66 _setmsg eec0 _secnd eece _tksa fe73 _memtop fe82 _membot eb1e _scnkey fe6f _settmo ef19 _acptr
eee4 _ciout eef6 _untalk ef04 _unlsn ee17 _listn ee14 _talk fe57 _readss fe50 _setlfs fe49 _setnam f542 _load
f675 _save f767 _settim f760 _rdtim f73f _udtim e505 _screen e50a _plot e500 _iobase
fd52 restor_vector fdf9 ioinit_vector e518 screeninit_vector fd8d ram_init e45b basic_vector_init e3a4 basic_ram_init
"""
# Address and name of the vic20's registers and system variables.
VIC20_REGISTERS = """
0281 MSMSTR 0282 MSMSTR_MSB 0286 color_mode 0287 cursor_color 0288 screen_map_page 0289 XMAX 028a RPTFLG 028b KOUNT
028c DELAY 028d SHFLAG 028e LSTSHF 028f KEYLOG 0290 KEYLOG_MSB 0291 MODE 0292 AUTODN 0300 IERROR 0301 IERROR_MSB
0302 IMAIN 0303 IMAIN_MSB 0304 ICRNCH 0305 ICRNCH_MSB 0306 IQPLOP 0307 IQPLOP_MSB 0308 IQGONE 0309 IGONE_MSB 030a IEVAL
030b IEVAL_MSB 030c SAREG 030d SXREG 030e SYREG 030f SPREG 0314 CINV 0315 CINV_MSB 0316 break_interrupt_vector
0317 break_interrupt_vector_msb 0318 nmi_vector 0319 nmi_vector_msb 033c TPHDRID 033d TPHBGN 033e TPHBGN_MSB
033f TPHEND 0340 TPHEND_MSB 0341 TPHNAME
9000 VICCR0 9001 VICCR1 9002 VICCR2 9003 VICCR3 9004 VICCR4 9005 VICCR5 9006 VICCR6 9007 VICCR7 9008 VICCR8 9009 VICCR9
900a VICCRA 900b VICCRB 900c VICCRC 900d VICCRD 900e VICCRE 900f VICCRF
9110 VIA1PB 9111 VIA1PA1 9112 VIA1DDRB 9113 VIA1DDRA 9114 VIA1T1CL 9116 VIA1T1LL 9117 VIA1T1LH 9118 VIA1T2CL
9119 VIA1T2CH 911a VIA1SR 911b VIA1CR 911c VIA1PCR 911d VIA1IFR 911e VIA1IER 911f VIA1PA2
9120 VIA2PB 9121 VIA2PA1 9122 VIA2DDRB 9123 VIA2DDRA 9124 VIA2T1CL 9126 VIA2T1LL 9127 VIA2T1LH 9128 VIA2T2CL
9129 VIA2T2CH 912a VIA2SR 912b VIA2CR 912c VIA2PCR 912d VIA2IFR 912e VIA2IER 912f VIA2PA2
"""
# Mapped areas (first and last address, name), from the systems' memory maps.
C64_AREAS = """
0000 00ff zero_page 0100 01ff stack 0400 07e7 screen 07f8 07ff sprite_pointers a000 bfff basic_rom d000 d02e vic
d400 d41c sid d800 dbe7 color_ram dc00 dc0f cia1 dd00 dd0f cia2 e000 ffff kernal_rom
"""
VIC20_AREAS = """
0000 00ff zero_page 0100 01ff stack 0277 0280 keyboard_buffer 033c 03fb tape_buffer 1e00 1fff screen 8000 8fff char_rom
9000 900f vic 9110 911f via1 9120 912f via2 9600 97ff color_ram c000 dfff basic_rom e000 ffff kernal_rom
"""
# What a group of symbols is about, by the beginning of their names; the rest by kind.
_ABOUT = (("VICCR", "video and sound chip"), ("VIA1", "versatile interface adapter 1"), ("VIA2", "versatile interface adapter 2"), ("TPH", "tape header"), ("S", "registers kept for SYS"), ("I", "vector of BASIC"))


def _parsed(text: str, fields: int) -> list[tuple[str, ...]]:
    words = text.split()
    return list(zip(*(words[i::fields] for i in range(fields)), strict=True))


def _described(name: str, kind: str) -> str:
    if name.lower().endswith("_msb"):
        return f"high byte of {name[:-4]}"
    if kind == "sub":
        return f"routine that {name[1:]} jumps to" if name[0] == "_" else "system routine"
    if kind == "map":
        return f"area {name}".replace("_", " ")
    return next((d for start, d in _ABOUT if name.startswith(start) and (len(start) > 1 or name in ("SAREG", "SXREG", "SYREG", "SPREG", "IERROR", "IMAIN", "ICRNCH", "IQPLOP", "IQGONE", "IEVAL"))), "system variable")


def rows() -> list[tuple[str, int, int, str, str, str]]:
    """system, addr, last, name, kind (sub, reg or map), description of all built-in symbols."""
    one = [("c64", a, a, n, "sub") for a, n in _parsed(C64_ROUTINES, 2)] + [("vic20", a, a, n, "sub") for a, n in _parsed(VIC20_ROUTINES, 2)]
    one += [("vic20", a, a, n, "reg") for a, n in _parsed(VIC20_REGISTERS, 2)]
    one += [(s, a, z, n, "map") for s, text in (("c64", C64_AREAS), ("vic20", VIC20_AREAS)) for a, z, n in _parsed(text, 3)]
    return [(s, int(a, 16), int(z, 16), n, k, _described(n, k)) for s, a, z, n, k in one]


def system_symbols(spark: SparkSession, system: str | None = None) -> DataFrame:
    """system, addr, last, name, kind, description of both systems' routines, registers and mapped areas, or of one."""
    return spark.createDataFrame([r for r in rows() if system in (None, r[0])], "system string, addr int, last int, name string, kind string, description string")


def addressed(symbols: DataFrame) -> DataFrame:
    """One row for each system and address that a symbol covers: the symbol that stands for it, an exact one before an area, a
    smaller area before a larger one, then by name. At most 65,536 rows a system, however large or many the areas are.

    symbols has addr and name; last (the end of an area), system, kind and description if they are there."""
    have = set(symbols.columns)
    given = lambda c, other: F.col(c) if c in have else other
    s = symbols.select(given("system", F.lit("own")).alias("system"), F.col("addr").cast("int").alias("addr"), F.coalesce(given("last", F.lit(None).cast("int")), F.col("addr")).cast("int").alias("last"), "name", given("kind", F.lit("reg")).alias("kind"), given("description", F.lit(None).cast("string")).alias("description"))
    s = s.where("addr IS NOT NULL AND name IS NOT NULL AND addr <= last AND addr <= 65535 AND last >= 0")
    cells = s.withColumn("target", F.explode(F.sequence(F.greatest("addr", F.lit(0)), F.least("last", F.lit(65535)))))
    best = F.row_number().over(Window.partitionBy("system", "target").orderBy(F.col("last") - F.col("addr"), "name"))
    return cells.withColumn("place", best).where("place = 1").select("system", "target", "addr", "name", "kind", "description")
