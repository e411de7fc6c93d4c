"""Codes of aviation surveillance: altitude, identity, call signs, labels and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bits as B

# Fixed values of the message format: type names of each category.
TYPE_NAMES = {
    1: {0: "NODET", 1: "PSR", 2: "SSR", 3: "CMB"},
    2: {1: "NORTH", 2: "SECTOR", 3: "SOUTH", 8: "BLIND_START", 9: "BLIND_STOP"},
    8: {254: "SOP", 255: "EOP"},
    10: {1: "TARGET", 2: "START_UPDATE", 3: "PERIODIC", 4: "EVENT"},
    19: {1: "START_UPDATE", 2: "PERIODIC", 3: "EVENT"},
    20: {64: "NON_MODE_S", 32: "MODE_S", 16: "HF", 8: "VDL4", 4: "UAT", 2: "DME", 1: "OTHER"},
    34: {1: "NORTH", 2: "SECTOR", 3: "GEO_FILTER", 4: "JAMMING"},
    48: {0: "NODET", 1: "PSR", 2: "SSR", 3: "CMB", 4: "SSRS_GEN", 5: "SSRS_ROLL", 6: "CMBS_GEN", 7: "CMBS_ROLL"},
}
# The six-bit alphabet of call signs.
SIX_BIT = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ@@@@@ @@@@@@@@@@@@@@@0123456789@@@@@@"


def mode_c_feet(value: Column, compat: bool = False) -> Column:
    """14-bit flight level in quarters to feet. compat: 8192 itself counts as positive."""
    v = value.bitwiseAND(F.lit(0x3FFF))
    negative = v > 8192 if compat else v >= 8192
    return (F.when(negative, v - 16384).otherwise(v) * 25).cast("int")


def mode_a_octal(value: Column) -> Column:
    return F.lpad(F.conv(value.cast("string"), 10, 8), 4, "0")


def mode_s_hex(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("long")), 6, "0")


def callsign(value: Column) -> Column:
    """48 bits as eight six-bit characters, trailing spaces trimmed."""
    letters = F.lit(SIX_BIT)
    return F.rtrim(F.concat(*(F.substring(letters, (B.field(value, 42 - 6 * k, 63) + 1).cast("int"), F.lit(1)) for k in range(8))))


def gray_altitude(bits: list[Column]) -> Column:
    """Feet from the Gray-coded bits D1 D2 D4 A1 A2 A4 B1 B2 B4 (500 ft bands) and C1 C2 C4 (100 ft steps), as ints.

    C counts 1 to 5 inside a band, and backwards in odd ones.
    """

    def binary(of: list[Column]) -> Column:
        total, acc = F.lit(0), F.lit(0)
        for b in of:
            acc = acc.bitwiseXOR(b)
            total = total * 2 + acc
        return total

    fives, ones = binary(bits[:-3]), binary(bits[-3:])
    ones = F.when(ones == 7, 5).otherwise(ones)
    ones = F.when(fives % 2 == 1, 6 - ones).otherwise(ones)
    return (fives * 500 + ones * 100 - 1300).cast("int")


def type_name(cat: Column, code: Column) -> Column:
    """The name of a message type, null for unknown ones."""
    out = F.lit(None).cast("string")
    for c, names in TYPE_NAMES.items():
        table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        out = F.when(cat == c, F.try_element_at(table, code.cast("int"))).otherwise(out)
    return out


def sensor_key(sac: Column, sic: Column, cat: Column) -> Column:
    return F.format_string("%03d_%03d_%03d", sac.cast("int"), sic.cast("int"), cat.cast("int"))


def time_text(seconds: Column) -> Column:
    """Seconds since midnight as HH:MM:SS.mmm."""
    ms = F.floor(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def block_key(payload: Column) -> Column:
    """What identical blocks share: length and a checksum that doesn't collide in practice; null for none."""
    return F.concat(F.length(payload).cast("string"), F.lit(":"), F.sha2(payload, 256))


def crc_key(payload: Column) -> Column:
    """The classic 32-bit key of a block: the CRC's register taken on over the length, as eight hex digits.

    The finished CRC of the block is fed back as the register, so this is no plain CRC of a longer string:
    from a register r, four more bytes give T(r xor bytes), and T is linear. What T gives for r is
    the CRC's own register after four zero bytes, here by xor of one table value a bit.
    """
    poly = 0xEDB88320
    table = []
    for k in range(32):
        r = 1 << k
        for _ in range(32):
            r = (r >> 1) ^ (poly if r & 1 else 0)
        table.append(r)
    start = F.crc32(payload).bitwiseXOR(F.length(payload).cast("long"))
    out = F.lit(0).cast("long")
    for k, value in enumerate(table):
        out = out.bitwiseXOR(F.when(B.bit(start, 1 << k), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return F.lpad(F.hex(out.bitwiseXOR(F.lit(0xFFFFFFFF))), 8, "0")
