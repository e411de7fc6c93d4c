"""Bytes to numbers and back, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(payload: Column, start: Column | int, n: int) -> Column:
    """n bytes from the one-based start, most significant first, as a long; null beyond the end."""
    cut = F.substring(payload, F.lit(start) if isinstance(start, int) else start, F.lit(n))
    return F.when(F.length(cut) == n, F.conv(F.hex(cut), 16, 10).cast("long"))


def unsigned_le(payload: Column, start: Column | int, n: int) -> Column:
    """As unsigned(), least significant byte first."""
    at = F.lit(start) if isinstance(start, int) else start
    total = unsigned(payload, at, 1)
    for k in range(1, n):
        total = total + unsigned(payload, at + k, 1) * (1 << 8 * k)
    return total


def signed(value: Column, bits: int) -> Column:
    """Two's complement of so many bits."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def be(value: Column, n: int) -> Column:
    """An integer as n bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def le(value: Column, n: int) -> Column:
    """An integer as n bytes, least significant first."""
    v = value.cast("long")
    return F.concat(*(be(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)), 1) for k in range(n)))


def bit(value: Column, mask: int) -> Column:
    """Whether any bit of the mask is set."""
    return value.bitwiseAND(F.lit(mask)) != 0


def field(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def has_item(payload: Column, mask: int) -> Column:
    """Whether the first presence byte of a block's first record has a bit of the mask."""
    return bit(unsigned(payload, 4, 1), mask)


def hex_dump(payload: Column, block_id: Column | None = None, letter: Column | None = None) -> Column:
    """"%02X " for each byte, behind an id and a letter if given."""
    dump = F.regexp_replace(F.hex(payload), "(..)", "$1 ")
    return dump if block_id is None else F.concat(block_id.cast("string"), letter if letter is not None else F.lit(""), F.lit(" "), dump)
