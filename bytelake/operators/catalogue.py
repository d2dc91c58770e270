"""Magic signatures, in catalogue order. Names, hex bytes, offsets, masks, platforms, confidences."""

# name, bytes, offset
BASIC = """
c64_prg 0108 0
c64_basic_start 0B08 0
c64_cartridge C3C2CD3830 0
vic20_prg 0110 0
vic20_basic_start 0B10 0
apple2_dos33 A527C909 0
apple2_prodos 0138B003 0
bbc_basic 00000000000000 7
assembly_jmp_start 4C 0
assembly_sei_start 78 0
assembly_lda_start A9 0
"""

# name, bytes, offset, mask (- for none), platform (- for none), confidence
ENHANCED = """
c64_prg_basic 0108 0 - c64 0.8
c64_basic_start 0B08 0 - c64 0.7
c64_sys_1300 0C05 0 - c64 0.7
c64_prg_2000 0020 0 - c64 0.6
c64_prg_4000 0040 0 - c64 0.6
c64_prg_c000 00C0 0 - c64 0.6
c64_cartridge_cbm80 C3C2CD3830 0 - c64 0.9
c64_cartridge_header C5000000 0 F0000000 c64 0.8
c64_cartridge_init 4CF8FF 0 - c64 0.85
c64_cartridge_8000 0080 0 - c64 0.85
c64_cartridge_e000 00E0 0 - c64 0.85
c64_cartridge_magic 4336342043415254 16 - c64 0.95
c64_crt_header 43363420434152545249444745202020 0 - c64 0.95
c64_crt_header_alt 433634 0 - c64 0.9
c64_crt_chip 43484950 64 - c64 0.9
c64_basic_line0 0C080A009E 0 - c64 0.85
c64_basic_rem 0C080A008F 0 - c64 0.8
c64_sid_magic 50534944 0 - c64 0.95
c64_rsid_magic 52534944 0 - c64 0.95
vic20_prg_unexpanded 0110 0 - vic20 0.95
vic20_prg_3k 0104 0 - vic20 0.9
vic20_basic_1201 0112 0 - vic20 0.9
vic20_basic_1201_alt 0212 0 - vic20 0.8
vic20_basic_start_token 0B1000009E 0 - vic20 0.9
vic20_ml_standard 200070 2 - vic20 0.85
vic20_a000_block 00A0 0 - vic20 0.8
vic20_2000_block 0020 0 - vic20 0.7
vic20_color_ram_access 0096 15 FFF0 vic20 0.7
vic20_basic_rem_1001 0C100A008F 0 - vic20 0.85
vic20_basic_sys_1001 0C100A009E 0 - vic20 0.9
vic20_cartridge 4130C3C2CD 0 - vic20 0.9
vic20_cart_vector_a000 00A0 0 - vic20 0.6
vic20_mc_1c00 001C 0 - vic20 0.6
zx_snapshot_z80 000000000000000000 30 - zx 0.9
zx_snapshot_sna 000000000000000000 0 - zx 0.8
zx_tap_standard 130000 0 - zx 0.9
atari_executable FFFF 0 - atari8bit 0.9
atari_executable_with_address FFFF0060 0 - atari8bit 0.9
atari_basic_tokenized 00030007 0 - atari8bit 0.8
msx_basic D3D3D3 0 - msx 0.8
msx_rom_signature 4142 0 - msx 0.8
nes_rom 4E45531A 0 - nes 0.95
apple2_dos33 A527C909 0 - apple2 0.8
apple2_prodos 0138B003 0 - apple2 0.8
bbc_basic 00000000000000 7 - bbc 0.8
assembly_jmp_start 4C 0 - - 0.4
assembly_sei_start 78 0 - - 0.4
assembly_lda_start A9 0 - - 0.4
assembly_jsr_pattern 20 2 - - 0.4
assembly_cli_pattern 58 2 - - 0.4
pattern_init_sequence 78A9008D 0 - - 0.7
pattern_interrupt_handler 488A489848 0 - - 0.7
"""

PLATFORMS = ("c64", "vic20", "zx", "atari8bit", "msx", "nes", "apple2", "bbc")
C64_ADDRESSES = (0x0801, 0xA000, 0x8000, 0xC000, 0x2000, 0x4000)
VIC20_ADDRESSES = (0x1001, 0x0401, 0x1201, 0xA000, 0x2000, 0x4000, 0x6000)
