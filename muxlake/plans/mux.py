"""Transport streams from tables: sections, packets and time stamps written with built-in functions.

Queries mux driver tables into bytes and decode them again, so that SQL over the tables can check every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.functions.bits import Value, be, fill, join, once, part
from muxlake.functions.checks import with_crc


def pcr_field(ticks: Column) -> Column:
    """Six bytes: 33 bits of base, six reserved ones, nine of extension."""
    base, extension = F.floor(ticks / 300), ticks % 300
    return join(be(F.shiftright(base, 1), 4), be(base % 2 * 32768 + 0x7E00 + extension, 2))


def pts_field(prefix: int, ticks: Column) -> Column:
    """Five bytes: a prefix and 33 bits in three parts with marker bits."""
    high, mid, low = F.shiftright(ticks, 30), F.shiftright(ticks, 15) % 32768, ticks % 32768
    return join(be(prefix * 16 + high * 2 + 1, 1), be(mid * 2 + 1, 2), be(low * 2 + 1, 2))


def packet(pid: Value, cc: Value, payload: Column | None = None, pusi: Value = 0, field: Column | None = None, tei: Value = 0) -> Column:
    """One packet of 188 bytes; field is the adaptation field after its length, which grows to fill the packet."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    nothing = F.unhex(F.lit(""))
    head = join(be(0x47, 1), be(col(tei) * 32768 + col(pusi) * 16384 + col(pid), 2))
    carries = 16 if payload is not None else 0

    def built(x: Column) -> Column:
        room = F.lit(183) - F.length(x)
        if field is None:
            stuffed = F.when(room > 0, join(be(room, 1), be(0, 1), fill(room - 1))).when(room == 0, be(0, 1)).otherwise(nothing)
            return join(head, be(F.when(room >= 0, 32 + carries).otherwise(carries) + col(cc), 1), stuffed, x)
        filled = once(field, lambda f: join(be(room, 1), f, fill(room - F.length(f))))
        return join(head, be(32 + carries + col(cc), 1), filled, x)

    return once(payload if payload is not None else nothing, built)


def section(table_id: Value, extension: Value, body: Column, version: Value = 0, number: Value = 0, last: Value = 0) -> Column:
    """A section with the long header and its CRC."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    rest = join(be(extension, 2), be(col(version) * 2 + 0xC1, 1), be(number, 1), be(last, 1))
    return with_crc(once(body, lambda x: join(be(table_id, 1), be(F.length(x) + 9 + 0xB000, 2), rest, x)))


def descriptor(tag: int, data: Column) -> Column:
    return once(data, lambda x: join(be(tag, 1), be(F.length(x), 1), x))


def text(column: Column, most: int = 250) -> Column:
    """A byte of length and the text."""
    return once(F.substring(F.encode(column, "UTF-8"), 1, most), lambda x: join(be(F.length(x), 1), x))


def loop(data: Column, flags: int = 0xF000) -> Column:
    """Twelve bits of length and the data."""
    return once(data, lambda x: join(be(F.length(x) + flags, 2), x))


def section_packets(sections: DataFrame, key: str = "source", span: str | None = None, partitions: int | None = None) -> DataFrame:
    """(key, byte_offset, raw) of the packets of sections(key, pid, seq, section), each section from a packet of its own.

    Continuity counts within a PID and offsets within a key, both in one order: of seq, pid and the section's bytes, so that sections of the same
    seq have theirs too. Sections are numbered by running totals of their packets before they are cut.

    span: a number that grows with seq. Sections are then put in order within a span, and totals of the spans before are added, so no task holds a key.
    partitions: how many those are dealt to.
    """
    by, n = [key] if span is None else [key, span], F.floor(F.length("section") / 184).cast("long") + 1
    dealt = sections if partitions is None or span is None else sections.repartition(partitions, *by)
    before = lambda by, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = dealt.select(*by, "pid", "seq", join(be(0, 1), F.col("section")).alias("data"), n.alias("n"))
    placed = counted.withColumn("of_key", before(by, "seq", "pid", "data")).withColumn("of_pid", before([*by, "pid"], "of_key"))
    if span is not None:
        # seq is summed up only so that both sides read the same columns, and with them the same exchange.
        sums = dealt.groupBy(*by, "pid").agg(F.sum(n).alias("n"), F.max("seq").alias("last"))
        earlier = F.sum("n").over(Window.partitionBy(key).orderBy(span).rangeBetween(Window.unboundedPreceding, -1))
        told = sums.where("last IS NOT NULL").select(F.col(key).alias("k"), F.col(span).alias("s"), F.col("pid").alias("p"), F.coalesce(earlier, F.lit(0)).alias("key_before"), before([key, "pid"], span).alias("pid_before"))
        placed = placed.join(told, F.col(key).eqNullSafe(F.col("k")) & F.col(span).eqNullSafe(F.col("s")) & F.col("pid").eqNullSafe(F.col("p")))
        placed = placed.withColumns({"of_key": F.col("of_key") + F.col("key_before"), "of_pid": F.col("of_pid") + F.col("pid_before")})
    chunks = placed.select(key, "pid", "data", "of_key", "of_pid", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    raw = once(part(F.col("data"), F.col("k") * 184, 184), lambda x: join(x, fill(F.lit(184) - F.length(x))))
    made = packet(F.col("pid"), (F.col("of_pid") + F.col("k")) % 16, raw, (F.col("k") == 0).cast("int"))
    return chunks.select(key, ((F.col("of_key") + F.col("k")) * 188).cast("long").alias("byte_offset"), made.alias("raw"))
