"""Commutative checksums: CRC32 values combined by adding their four bytes lane by lane, modulo 256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc_of(data: Column) -> Column:
    """CRC32 of text or bytes as an unsigned value."""
    return F.crc32(data.cast("binary"))


def combined_crc(crc: Column) -> Column:
    """Aggregate: lane-wise sum of CRC values, whatever their order; an unsigned value."""
    lanes = [F.pmod(F.sum(F.shiftright(crc, 8 * i).bitwiseAND(255)), F.lit(256)) for i in range(4)]
    return sum((F.shiftleft(lane.cast("long"), 8 * i) for i, lane in enumerate(lanes)), F.lit(0).cast("long"))


def combine_two(a: Column, b: Column) -> Column:
    """combined_crc of two values."""
    lanes = [F.pmod(F.shiftright(a, 8 * i).bitwiseAND(255) + F.shiftright(b, 8 * i).bitwiseAND(255), F.lit(256)) for i in range(4)]
    return sum((F.shiftleft(lane.cast("long"), 8 * i) for i, lane in enumerate(lanes)), F.lit(0).cast("long"))
