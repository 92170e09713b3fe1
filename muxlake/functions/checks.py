"""Checksums of transport streams, from built-in functions.

CRC-32/MPEG-2 is the zlib CRC of bytes whose bits are reversed, complemented and reversed itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muxlake.functions.bits import be, once

# The hexadecimal digits, and the digits of their four bits in reverse.
DIGITS, REVERSED = "0123456789ABCDEF", "084C2A6E195D3B7F"


def crc32_mpeg2(data: Column) -> Column:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, all ones at the start, nothing reversed."""
    flipped = F.unhex(F.regexp_replace(F.translate(F.hex(data), DIGITS, REVERSED), "(.)(.)", "$2$1"))
    plain = F.crc32(flipped).bitwiseXOR(0xFFFFFFFF)
    return F.conv(F.reverse(F.lpad(F.bin(plain), 32, "0")), 2, 10).cast("long")


def with_crc(data: Column) -> Column:
    return once(data, lambda x: F.concat(x, be(crc32_mpeg2(x), 4)))


def crc8_dvb(data: Column) -> Column:
    """CRC-8 with polynomial 0xD5 and zero at the start, bit by bit over short headers."""

    def byte(crc: Column, k: Column) -> Column:
        value = F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int")
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(value),
            lambda c, _: F.when(c >= 128, F.shiftleft(c, 1).bitwiseAND(255).bitwiseXOR(0xD5)).otherwise(F.shiftleft(c, 1)),
        )

    return F.when(F.length(data) > 0, F.aggregate(F.sequence(F.lit(1), F.length(data)), F.lit(0), byte)).otherwise(0)
