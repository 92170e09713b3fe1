"""Bit fields of binary columns, read and written with built-in functions only.

Offsets count bytes or bits from 0. A field beyond the end of its column is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int


def _column(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def part(data: Column, start: Value, size: Value) -> Column:
    """size bytes from start; fewer where the column ends before."""
    return F.substring(data, _column(start) + 1, _column(size))


def uint(data: Column, start: Value, size: int = 1) -> Column:
    """The big-endian unsigned integer of size bytes (7 at most), as a long."""
    raw = part(data, start, size)
    if size == 1:  # no byte gives no digit, and that null: the place is in the plan once
        return F.conv(F.hex(raw), 16, 10).cast("long")
    return F.when(F.length(raw) == size, F.conv(F.hex(raw), 16, 10).cast("long"))


def bits(data: Column, start: Value, offset: int, width: int) -> Column:
    """width bits (56 at most) from a bit offset after a byte."""
    first, last = offset // 8, (offset + width - 1) // 8
    word = uint(data, _column(start) + first, last - first + 1)
    return F.shiftright(word, (last + 1) * 8 - offset - width).bitwiseAND((1 << width) - 1)


def flag(data: Column, start: Value, offset: int) -> Column:
    return bits(data, start, offset, 1) == 1


def sint(data: Column, start: Value, size: int) -> Column:
    """A two's complement integer."""
    value = uint(data, start, size)
    return F.when(value >= 1 << (8 * size - 1), value - (1 << 8 * size)).otherwise(value)


def be(value: Value, size: int) -> Column:
    """A non-negative integer as size big-endian bytes."""
    return F.unhex(F.lpad(F.hex(_column(value).cast("long")), 2 * size, "0"))


def fill(count: Value, byte: int = 0xFF) -> Column:
    """A byte, count times."""
    return F.unhex(F.repeat(F.lit(f"{byte:02X}"), _column(count).cast("int")))


def join(*parts: Column) -> Column:
    return F.concat(*parts)


def once(value: Column, body) -> Column:
    """body(value), with value in the plan and computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walk(data: Column, start: Value, end: Value, header: int, size, stop=None) -> Column:
    """The byte ranges (pos, size) of the entries of a loop; size(pos) is an entry's whole size.

    The loop ends at its end, at an entry that does not fit, is shorter than its header or for which stop(pos) holds.
    """
    start, end = _column(start).cast("int"), _column(end).cast("int")

    def step(state: Column, _: Column) -> Column:
        pos = state["pos"]
        n = size(pos).cast("int")
        fits = (pos + header <= end) & n.isNotNull() & (n >= header) & (pos + n <= end)
        if stop is not None:
            fits = fits & ~F.coalesce(stop(pos), F.lit(True))
        entry = F.struct(pos.alias("pos"), n.alias("size"))
        more = F.struct((pos + n).alias("pos"), F.array_append(state["entries"], entry).alias("entries"), state["open"].alias("open"))
        over = F.struct(pos.alias("pos"), state["entries"].alias("entries"), F.lit(False).alias("open"))
        return F.when(state["open"] & fits, more).otherwise(over)

    none = F.array().cast("array<struct<pos:int,size:int>>")
    most = F.greatest(F.lit(0), F.floor((end - start) / header)).cast("int")
    zero = F.struct(start.alias("pos"), none.alias("entries"), F.lit(True).alias("open"))
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda s: s["entries"])).otherwise(none)
